"""Row shaping and text metrics as Column expressions (JVM side, no Python workers)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairmill.schema import HANGUL, INPUT_KEYS, OUTPUT_KEYS, Script

# Blanks of the source rules: Unicode white space and U+001C..U+001F. Listed one by one, which the
# regex engine tests faster than a Unicode property, and which plain trimming can use as well.
ODD_BLANK = r"\t\n\x0b\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = "".join(map(chr, (32, *range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def count_re(c, pattern: str) -> Column:
    return F.regexp_count(text(c), F.lit(pattern)).cast("long")


def _members(chars: str) -> str | None:
    """All characters of a plain class such as 'A-Z가-힣'; None for escapes and negations."""
    if "\\" in chars or chars.startswith("^"):
        return None
    out, i = [], 0
    while i < len(chars):
        if i + 2 < len(chars) and chars[i + 1] == "-":
            out += map(chr, range(ord(chars[i]), ord(chars[i + 2]) + 1))
            i += 3
        else:
            out.append(chars[i])
            i += 1
    return "".join(out)


def count_in(c, chars: str) -> Column:
    """Characters of ``c`` inside the class ``chars``.

    Plain classes are counted by deleting their members with a table lookup, about three times
    faster on dense classes than collecting regex matches.
    """
    members = _members(chars)
    if members is None:
        return count_re(c, f"[{chars}]")
    return (F.length(text(c)) - F.length(F.translate(text(c), members, ""))).cast("long")


def count_without(c, chars: str) -> Column:
    """Characters of ``c`` outside the sparse class ``chars``, whose runs are deleted: a match a word, and none is collected."""
    return F.length(F.regexp_replace(text(c), f"[{chars}]+", "")).cast("long")


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    return F.when(den == 0, F.lit(empty)).otherwise(num.cast("double") / den)


# ------------------------------------------------------------------ shaping


def normalize_space(c) -> Column:
    """Runs of blanks to one space, ends trimmed. Single spaces, the common case, match nothing."""
    return F.trim(F.regexp_replace(text(c), rf" *[{ODD_BLANK}][ {ODD_BLANK}]*| {{2,}}", " "))


def strip(c) -> Column:
    return F.btrim(text(c), F.lit(BLANKS))


def clean_text(c, max_chars: int | None = None) -> Column:
    """CRLF to LF, blanks collapsed, three or more newlines to two, strip, optional cut."""
    t = F.regexp_replace(text(c), r"\r\n?", "\n")
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = strip(F.regexp_replace(t, "\n{3,}", "\n\n"))
    return t if max_chars is None else strip(F.substring(t, 1, max_chars))


def pick_first_non_empty(columns: Iterable[str | Column]) -> Column:
    return F.coalesce(*[F.nullif(normalize_space(c), F.lit("")) for c in columns], F.lit(""))


def extract_pair(columns: Sequence[str], term_suffix: str = "란?") -> tuple[Column, Column]:
    """(input, output) by alias order; falls back to (term + suffix, answer)."""
    have = set(columns)
    inp = pick_first_non_empty([k for k in INPUT_KEYS if k in have])
    out = pick_first_non_empty([k for k in OUTPUT_KEYS if k in have])
    ok = (inp != "") & (out != "")
    if "term" not in have or "answer" not in have:
        return F.when(ok, inp).otherwise(""), F.when(ok, out).otherwise("")
    term, answer = normalize_space("term"), normalize_space("answer")
    alt = (term != "") & (answer != "")
    return (
        F.when(ok, inp).when(alt, F.concat(term, F.lit(term_suffix))).otherwise(""),
        F.when(ok, out).when(alt, answer).otherwise(""),
    )


def passthrough(columns: Iterable[str]) -> list[Column]:
    return [F.nullif(normalize_space(c), F.lit("")).alias(c) for c in columns]


def stable_id(prefix: str, parts: Sequence[Column | str], width: int = 20) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("\n", *[text(p) for p in parts])), 1, width))


def format_example(inp, out) -> Column:
    return F.concat(F.lit("### Instruction\n"), text(inp), F.lit("\n\n### Response\n"), text(out), F.lit("\n"))


def response_offset(inp) -> Column:
    """Position (0-based) of the response inside :func:`format_example`."""
    return F.length(F.concat(F.lit("### Instruction\n"), text(inp), F.lit("\n\n### Response\n"))).cast("long")


def approx_tokens(inp, out) -> Column:
    """Bytes of the formatted example plus begin and end marks."""
    return (F.octet_length(format_example(inp, out)) + 2).cast("long")


def strip_known_prompt(c, heads: Sequence[str], head_contains: Sequence[str] = ()) -> Column:
    s = strip(c)
    head = F.substring_index(s, "\n\n", 1)
    known = head.isin(list(heads))
    for mark in head_contains:
        known = known | F.lower(head).contains(mark.lower())
    rest = strip(F.substr(s, F.length(head) + 3))
    return F.when(s.contains("\n\n") & known, rest).otherwise(s)


def strip_tags(c) -> Column:
    s = normalize_space(F.regexp_replace(text(c), "<[^>]+>", " "))
    return F.replace(F.replace(s, F.lit(" ,"), F.lit(",")), F.lit(" ."), F.lit("."))


def trim_ellipsis(c, max_chars: int) -> Column:
    s = normalize_space(c)
    cut = F.concat(F.rtrim(F.substring(s, 1, max(20, max_chars - 3))), F.lit("..."))
    return F.when(F.length(s) <= max_chars, s).otherwise(cut)


def first_sentence(c, max_chars: int = 220) -> Column:
    """First sentence within ``max_chars``; pieces under four characters are not accepted."""
    s = normalize_space(c)
    head = F.substring(s, 1, max_chars)
    cut = F.trim(F.regexp_extract(head, r"\A(.*?[.!?])(?:\s|\z)", 1))
    return F.when(F.length(cut) >= 4, cut).otherwise(F.trim(head))


def simplify_question(c, fillers: Sequence[str], cut_before: str | None = None) -> Column:
    """First non-empty line, cut before a format hint, leading filler words removed."""
    line = F.coalesce(F.get(F.filter(F.split(text(c), "\r?\n"), lambda x: normalize_space(x) != ""), F.lit(0)), F.lit(""))
    s = normalize_space(line)
    if cut_before:
        s = F.trim(F.regexp_replace(s, cut_before + r".*\z", ""))
    alt = "|".join(_quote(f) for f in sorted(fillers, key=len, reverse=True))
    return F.trim(F.regexp_replace(s, rf"\A(?:(?:{alt}) +)+", ""))


def normalize_output(c, prefixes: str, tail: str | None = None) -> Column:
    """Drop answer prefixes and a tail, '.0' off whole numbers, end with a period."""
    s = F.regexp_replace(strip(c), rf"\A\s*(?:{prefixes})\s*", "")
    if tail:
        s = F.regexp_replace(s, rf"(?i)\s*(?:{tail})\s*\z", "")
    s = normalize_space(s)
    s = F.when(s.rlike(r"\A[-+]?\d+\.0\z"), F.regexp_replace(s, r"\.0\z", "")).otherwise(s)
    return F.when((s == "") | s.endswith("."), s).otherwise(F.concat(s, F.lit(".")))


def normalize_license(c) -> Column:
    return F.lower(normalize_space(c))


def tier_rank(c) -> Column:
    t = F.lower(strip(c))
    return F.when(t == "high", 2).when(t == "mid", 1).otherwise(0).cast("long")


def rank_to_tier(rank: Column) -> Column:
    return F.when(rank >= 2, "high").when(rank == 1, "mid").otherwise("base")


def tier_hardness(c) -> Column:
    t = F.lower(strip(c))
    return F.when(t == "high", "hard").when(t == "mid", "soft").otherwise("observational")


def group_key(*cols) -> Column:
    parts = [F.nullif(F.lower(strip(c)), F.lit("")) for c in cols]
    return F.coalesce(F.nullif(F.concat_ws("|", *parts), F.lit("")), F.lit("default"))


def _quote(s: str) -> str:
    return "".join("\\" + ch if ch in r".\+*?[]^$(){}|-/" else ch for ch in s)


def any_of(words: Iterable[str]) -> str:
    """Alternation matching any of the literal words."""
    return "(?:" + "|".join(_quote(w) for w in words) + ")"


# ------------------------------------------------------------------ metrics


def script_count(c, script: Script = HANGUL) -> Column:
    return count_in(c, script.symbols)


def script_ratio_letters(c, script: Script = HANGUL) -> Column:
    return ratio(count_in(c, script.symbols), count_in(c, script.letters))


def script_ratio_chars(c, script: Script = HANGUL) -> Column:
    return ratio(count_in(c, script.symbols), F.length(text(c)))


def script_ratio_nonspace(c, script: Script = HANGUL) -> Column:
    return ratio(count_in(c, script.symbols), count_without(c, f" {ODD_BLANK}"))


def script_ratio_alnum(c, script: Script = HANGUL) -> Column:
    return ratio(count_in(c, script.symbols), alnum_count(c))


def latin_ratio(c, script: Script = HANGUL) -> Column:
    return ratio(count_in(c, "A-Za-z"), count_in(c, script.letters))


def digit_ratio(c) -> Column:
    return ratio(count_in(c, r"\p{Nd}"), F.length(text(c)), empty=1.0)


def weird_ratio(c) -> Column:
    return ratio(count_in(c, r"\x00-\x08\x0b\x0c\x0e-\x1f"), F.length(text(c)), empty=1.0)


def binary_ratio(c) -> Column:
    return ratio(count_in(c, r"\x00-\x08\x0e-\x1f"), F.length(text(c)), empty=1.0)


def code_symbol_ratio(c) -> Column:
    return ratio(count_in(c, r"{}\[\]<>;=()#`"), F.length(text(c)))


def clean_char_ratio(c, script: Script = HANGUL) -> Column:
    return ratio(count_in(c, rf"{script.token} {ODD_BLANK}.,:;()/%+\-\"'`"), F.length(text(c)))


def alnum_count(c) -> Column:
    return count_without(c, r"^\p{L}\p{N}")


def question_count(c) -> Column:
    return F.length(text(c)) - F.length(F.replace(text(c), F.lit("?"), F.lit("")))


def words(c, script: Script = HANGUL, min_len: int = 2) -> Column:
    n = "+" if min_len <= 1 else f"{{{min_len},}}"
    return F.regexp_extract_all(F.lower(text(c)), F.lit(f"[{script.token}]{n}"), F.lit(0))


def token_diversity(toks: Column) -> Column:
    return ratio(F.size(F.array_distinct(toks)), F.size(toks), empty=1.0)


def top_count(items: Column) -> Column:
    """Largest number of equal elements: sort, then one pass over the runs.

    Linear after the sort and local to the row, so a 20,000-word text costs no
    shuffle and no quadratic scan.
    """
    start = F.struct(F.lit(None).cast("string").alias("v"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, x):
        run = F.when(acc["v"].eqNullSafe(x), acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("v"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.sort_array(items), start, step, lambda a: a["best"]).cast("long")


def bigrams(toks: Column) -> Column:
    n = F.size(toks)
    pairs = F.zip_with(
        F.slice(toks, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(toks, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(pairs)


def top_token_share(toks: Column) -> Column:
    return ratio(top_count(toks), F.size(toks))


def repetition_rule(n: Column, top: Column, big: Column, min_tokens: int = 8, share: float = 0.24) -> Column:
    """Too few different words: ``n`` tokens, the most frequent ``top`` times, a pair of neighbours ``big`` times."""
    return (n >= min_tokens) & (((top >= 4) & (ratio(top, n) >= share)) | (big >= 3))


def repetition_bad(c, script: Script = HANGUL, min_tokens: int = 8, share: float = 0.24) -> Column:
    # Over a lambda variable, so that the tokens are found once per row.
    one = F.transform(F.array(words(c, script, 1)), lambda k: repetition_rule(F.size(k), top_count(k), top_count(bigrams(k)), min_tokens, share))
    return F.get(one, F.lit(0))


def char_run(c, k: int) -> Column:
    """Some character repeated more than ``k`` times in a row."""
    return text(c).rlike(rf"([^\n])\1{{{k},}}")


def repeated_chunk(c, script: Script = HANGUL) -> Column:
    """A chunk of two or three script symbols directly repeated (one-symbol chunks ignored)."""
    only = F.regexp_replace(text(c), f"[^{script.symbols}]", "")
    return only.rlike(r"(?!(.)\1)(..)\2|(?!(.)\3\3)(...)\4")


def distinct_chars(c) -> Column:
    return F.size(F.array_distinct(F.split(text(c), ""))).cast("long") - F.when(text(c) == "", 1).otherwise(0)


def symbol_noise(c, script: Script = HANGUL, limit: int = 8) -> Column:
    odd = count_re(c, rf"(?U)[^\w\s\x1c-\x1f{script.symbols}.,!?():;\"'\-\[\]{{}}+/=*`~@#$%^&|\\]")
    return text(c).contains("�") | char_run(c, 10) | (odd >= limit)


def question_noise(c) -> Column:
    """'???' runs with many question marks, or a question-mark share over one fifth."""
    n, q = F.length(text(c)), question_count(c)
    return (text(c).rlike(r"\?{3,}") & (q >= F.greatest(F.lit(8), F.floor(n / 6)))) | (
        (q >= 12) & (q >= F.floor(n / 5))
    )


def sentences(c) -> Column:
    parts = F.split(text(c), rf"(?<=[.!?])[ {ODD_BLANK}]+|\n+")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def strip_particle(tok: Column, script: Script = HANGUL) -> Column:
    """First matching suffix in list order; the stem keeps at least two characters.

    With longer suffixes listed before the shorter ones they contain, list order equals the
    shortest stem, which one lazy match finds.
    """
    p = script.particles
    if not p:
        return tok
    if any(later.endswith(early) and later != early for i, early in enumerate(p) for later in p[i + 1:]):
        raise ValueError("list longer particles before the ones they end with")
    return F.regexp_replace(tok, rf"\A(.{{2,}}?){any_of(p)}\z", "$1")


def retrieval_tokens(c, script: Script = HANGUL) -> Column:
    stop = F.array(*[F.lit(s) for s in sorted(script.stopwords)])
    return F.array_except(F.array_distinct(words(c, script, 2)), stop)


def keyword_terms(c, script: Script = HANGUL, fillers: Iterable[str] = ()) -> Column:
    """Token set with the trailing particle stripped and filler words removed."""
    toks = F.transform(retrieval_tokens(c, script), lambda x: strip_particle(x, script))
    drop = F.array(*[F.lit(s) for s in sorted(set(fillers) | set(script.stopwords))])
    return F.array_except(F.array_distinct(F.filter(toks, lambda x: F.length(x) >= 2)), drop)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays of distinct tokens; both empty = 1, one empty = 0."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union == 0, 1.0).otherwise(inter.cast("double") / union)


def edit_ratio(a: Column, b: Column) -> Column:
    return 1.0 - F.levenshtein(a, b).cast("double") / F.greatest(F.length(a), F.length(b), F.lit(1))


def best_term_similarity(term, c, script: Script = HANGUL) -> Column:
    t = F.lower(strip(term))
    toks = F.array_distinct(words(c, script, 2))
    best = F.array_max(F.transform(toks, lambda x: edit_ratio(t, x)))
    return F.when((t == "") | (F.size(toks) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), best))


def final_consonant(c) -> Column:
    """The last syllable block ends in a consonant: picks the particle form."""
    cp = F.ascii(F.substring(text(c), -1, 1))
    return F.when(text(c) == "", False).otherwise(cp.between(0xAC00, 0xD7A3) & (F.pmod(cp - 0xAC00, F.lit(28)) != 0))


def with_particle(c, closed: str, opened: str) -> Column:
    return F.concat(text(c), F.when(final_consonant(c), F.lit(closed)).otherwise(F.lit(opened)))
