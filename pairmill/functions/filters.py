"""Predicates and reject reasons. A predicate is a boolean Column; a rule set is an ordered list of
(reason, predicate) whose first hit names the row's rejection (null = kept)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.functions import text as X
from pairmill.functions.lexicon import KOREAN, Lexicon
from pairmill.schema import HANGUL, Script

Rule = tuple[str, Column]

# Markers of broken or templated text.
REPLACEMENT = "�"
LABEL_ONLY = r"\A\s*(?:[A-D]|[0-9]+(?:\.[0-9]+)?)\s*\z"
TEMPLATE_ARTIFACT = r"\{\*[^{}]{0,400}\*\}"


def first_reason(rules: Sequence[Rule]) -> Column:
    """Name of the first failing rule. Order matters: it decides the reported reason."""
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules], F.lit(None).cast("string"))


def ci(pattern: str) -> str:
    return "(?iU)" + pattern


def ux(pattern: str) -> str:
    """Unicode meaning of the blank, digit and word classes, as in the source patterns."""
    return "(?U)" + pattern


def merged(inp, out) -> Column:
    return F.concat(X.text(inp), F.lit("\n"), X.text(out))


def outside(c, lo: int, hi: int) -> Column:
    n = F.length(X.text(c))
    return (n < lo) | (n > hi)


def missing_pair(inp, out) -> Column:
    return (X.text(inp) == "") | (X.text(out) == "")


def noise_text(c) -> Column:
    s = X.text(c)
    return s.contains(REPLACEMENT) | s.contains("??") | X.char_run(s, 10) | s.rlike(TEMPLATE_ARTIFACT)


def corrupt_text(c, language: Column, script: Script = HANGUL, jamo: str = "ㄱ-ㅣ", cjk: str = "一-鿿") -> Column:
    """Question noise for any language; for the script's language also jamo or CJK heavy text."""
    s = X.text(c)
    syl, jam, han = X.count_in(s, script.symbols), X.count_in(s, jamo), X.count_in(s, cjk)
    wide = X.count_in(s, r"^\x00-\x7f")
    script_bad = (
        ((syl == 0) & (wide >= 10) & (jam + han >= 8))
        | ((han >= 6) & (han > F.greatest(F.lit(2), syl)))
        | ((jam >= 8) & (jam > F.greatest(F.lit(4), F.floor(syl / 2))))
    )
    base = (s == "") | s.contains(REPLACEMENT) | X.question_noise(s)
    return base | (language.isin(*script.hints) & script_bad)


def label_only(c) -> Column:
    return X.text(c).rlike(LABEL_ONLY)


def echo(inp, out) -> Column:
    return F.lower(X.normalize_space(inp)) == F.lower(X.normalize_space(out))


def alnum_floor(c, at_least: int = 8, per: int = 14) -> Column:
    """True when the text has too few letters and digits for its length."""
    return X.alnum_count(c) < F.greatest(F.lit(at_least), F.floor(F.length(X.text(c)) / per))


def tier_reason(tier, allow_mid: bool = False, allow_missing: bool = False) -> list[Rule]:
    t = F.lower(X.strip(tier))
    good = (t == "high") | (t == "mid" if allow_mid else F.lit(False))
    return [("tier", (t != "") & ~good), ("missing_tier", (t == "") & F.lit(not allow_missing))]


def language_hint(cols: Iterable, script: Script = HANGUL) -> Column:
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.lower(X.strip(c)).isin(*script.hints)
    return hit


def language_rules(hint: Column, c, script: Script = HANGUL, min_count: int = 6, min_ratio: float = 0.14,
                   hinted_min: int = 2) -> list[Rule]:
    n, r = X.script_count(c, script), X.script_ratio_letters(c, script)
    return [
        ("ko_signal_weak", hint & (n < hinted_min)),
        ("non_ko", ~hint & ((n < min_count) | (r < min_ratio))),
    ]


def banned_substrings(c, needles: Iterable[str]) -> Column:
    s = F.lower(X.normalize_space(c))
    hit = F.lit(False)
    for n in needles:
        n = " ".join(n.split()).lower()
        if n:
            hit = hit | s.contains(n)
    return hit


def blocked_patterns(c, patterns: Iterable[str], extra: Iterable[str] = ()) -> Column:
    """One combined case-blind match; user patterns that do not compile are ignored."""
    usable = list(patterns)
    for p in extra:
        try:
            re.compile(p)
        except re.error:
            continue
        usable.append(p)
    return X.normalize_space(c).rlike(ci("|".join(f"(?:{p})" for p in usable))) if usable else F.lit(False)


def template_leak(c, lex: Lexicon = KOREAN) -> Column:
    return X.text(c).rlike(ci(lex.leak_ci))


def code_like(c, lex: Lexicon = KOREAN) -> Column:
    return X.text(c).rlike(ci(lex.code_ci))


def intro_or_leak(inp, out, lex: Lexicon = KOREAN) -> Column:
    q, a = X.normalize_space(inp), X.normalize_space(out)
    leak = ci(lex.leak_ci)
    return q.rlike(ci(lex.intro_query_ci)) | a.rlike(ci(lex.intro_answer_ci)) | q.rlike(leak) | a.rlike(leak)


def intro_only_answer(out, lex: Lexicon = KOREAN) -> Column:
    a = X.normalize_space(out)
    return (a == "") | a.rlike(ci(lex.intro_only_ci))


def style_leak(inp, out, lex: Lexicon = KOREAN) -> Column:
    """Banned phrase, or an intro-style answer or the assistant's name outside an intro question."""
    q, a = X.normalize_space(inp), X.normalize_space(out)
    intro = q.rlike(ci(lex.intro_query_ci))
    named = a.rlike(ci(lex.intro_answer_ci))
    if lex.assistant_name:
        named = named | F.lower(a).contains(lex.assistant_name)
    return (a == "") | banned_substrings(a, lex.banned_outputs) | (~intro & named)


def has_any(c: Column, words: Iterable[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def arithmetic_prompt(inp, lex: Lexicon = KOREAN, max_chars: int = 140) -> Column:
    p = X.normalize_space(inp)
    return (
        outside(p, 2, max_chars)
        | X.text(inp).contains("\n")
        | p.rlike(r"\d+\s*[+\-*/=]\s*\d+")
        | has_any(p, lex.arithmetic_markers + lex.style_markers)
        | has_any(F.lower(p), lex.code_markers)
    )


def general_output(out, script: Script = HANGUL, lex: Lexicon = KOREAN, lo: int = 8, hi: int = 240, digits: float = 0.22) -> Column:
    o = X.normalize_space(out)
    return (
        outside(o, lo, hi)
        | (X.script_count(o, script) == 0)
        | o.rlike("[Ѐ-ӿ]")
        | (X.digit_ratio(o) > digits)
        | X.repetition_bad(o, script)
        | has_any(o, lex.arithmetic_markers + lex.style_markers)
        | has_any(F.lower(o), lex.code_markers)
    )


def license_allowed(c, policy: str = "mit_only") -> Column:
    lic = F.upper(X.strip(c))
    if policy == "all":
        return F.lit(True)
    return (lic == "MIT") | (lic == "") if policy == "allow_missing" else lic == "MIT"


def is_mit(c) -> Column:
    return X.normalize_license(c).isin("mit", "mit license")


def license_source(df: DataFrame, trusted: DataFrame, license_col: str, file_col: str, strict: bool = False) -> DataFrame:
    """Adds ``mit_source``: row_license, else file_allowlist for trusted files, else null.

    ``trusted(file)`` lists files by name; the join broadcasts it only when counted small.
    """

    rows = F.when(is_mit(license_col), "row_license")
    if strict:
        return df.withColumn("mit_source", rows)
    names = trusted.select(F.col(trusted.columns[0]).alias(file_col), F.lit(True).alias("_trusted")).distinct()
    return (
        df.join(names, file_col, "left")
        .withColumn("mit_source", F.coalesce(rows, F.when(F.col("_trusted"), "file_allowlist")))
        .drop("_trusted")
    )


def source_excluded(dataset, source, prefixes: Sequence[str] = (), banned: Sequence[str] = (), license_col=None) -> Column:
    d = F.lower(X.strip(dataset))
    hit = d.startswith("synthetic_")
    for p in prefixes:
        hit = hit | X.strip(dataset).startswith(p)
    if banned:
        hit = hit | X.strip(source).isin(*banned)
    if license_col is not None:
        hit = hit | X.normalize_license(license_col).contains("generated in-project")
    return hit


def definition_mismatch(term, out, script: Script = HANGUL, similarity: float = 0.86) -> Column:
    """The term is neither contained in the answer nor within edit similarity of one of its tokens."""
    t, a = F.lower(X.strip(term)), F.lower(X.normalize_space(out))
    near = X.best_term_similarity(t, a, script) >= similarity
    return (t != "") & ~(F.contains(a, t) | near)


def required_terms_met(term, out, lex: Lexicon = KOREAN) -> Column:
    t, a = X.normalize_space(term), F.lower(X.normalize_space(out))
    ok = F.lit(True)
    for key, words in lex.required_terms:
        ok = F.when(t == key, has_any(a, [w.lower() for w in words])).otherwise(ok)
    return ok


def keyword_miss(inp, out, script: Script = HANGUL, lex: Lexicon = KOREAN, few: int = 4) -> Column:
    """No question keyword reaches the answer, for definition questions or short keyword lists."""
    q, a = X.keyword_terms(inp, script, lex.fillers), X.keyword_terms(out, script, lex.fillers)
    free = X.text(inp).rlike(ux(lex.logic)) | X.text(inp).rlike(ux(lex.math)) | X.text(inp).rlike(ux(lex.syllogism))
    return (F.size(q) > 0) & ~F.arrays_overlap(q, a) & ~free & (X.text(inp).rlike(ux(lex.definition)) | (F.size(q) <= few))


def answer_shape_rules(inp, out, lex: Lexicon = KOREAN) -> list[Rule]:
    q, a = X.text(inp), X.text(out)
    return [
        ("math_without_digits", q.rlike(ux(lex.math)) & ~a.rlike(r"\d")),
        ("syllogism_weak", q.rlike(ux(lex.syllogism)) & ~a.rlike(ux(lex.syllogism_words))),
    ]


def has_explanation(c, lex: Lexicon = KOREAN) -> Column:
    n = F.size(F.filter(F.split(X.text(c), r"(?U)[.!?][\s\x1c-\x1f]+|\n+"), lambda x: X.strip(x) != ""))
    return X.text(c).rlike(ux(lex.explain)) | (n >= 2)


def logic_input(c, lex: Lexicon = KOREAN, lo: int = 6, hi: int = 520, use_ban: bool = False) -> Column:
    s = X.clean_text(c)
    ok = s.rlike(ux(lex.logic_allow)) | (s.rlike(r"\d") & s.rlike(r"[+\-*/=^<>]"))
    return ~outside(s, lo, hi) & ok & (~s.rlike(ux(lex.logic_ban)) if use_ban else F.lit(True))


def solver_query(c, lex: Lexicon = KOREAN) -> Column:
    q = F.lower(X.strip(c))
    return q.rlike(r"\d+\s*[+\-*/]\s*\d+") | (q.contains("=") & q.rlike(r"\d")) | has_any(q, lex.solver_words)


def factoid(c, lex: Lexicon = KOREAN) -> Column:
    return solver_query(c, lex) | has_any(F.lower(X.strip(c)), lex.fact_words)


def contains_term(answer: Column, terms: Column) -> Column:
    return F.exists(terms, lambda k: F.contains(answer, k))


def low_quality_reason(inp, out, rare: Column, script: Script = HANGUL, lex: Lexicon = KOREAN) -> Column:
    """Composite verdict; ``rare`` is the rare-symbol share of the answer."""
    q, a = X.strip(inp), X.strip(out)
    low = F.lower(a)
    in_script = X.script_count(q, script) > 0
    n_script, n_latin = X.script_count(a, script), X.count_in(a, "A-Za-z")
    keys = X.keyword_terms(q, script, lex.fillers)
    words = X.words(a, script, 2)
    qt, at = X.retrieval_tokens(q, script), X.retrieval_tokens(a, script)
    hits = (
        low.rlike(r"\d+\s*[+\-*/]\s*\d+").cast("int")
        + (low.contains("=") & low.rlike(r"\d")).cast("int")
        + low.rlike(r"(?:\A|[^a-z0-9_])(?:result|answer|equation)(?:[^a-z0-9_]|\z)").cast("int")
    )
    return first_reason(
        [
            ("empty", a == ""),
            ("short", (F.length(a) < 8) & ~(factoid(q, lex) & (F.length(a) >= 4))),
            ("char_run", X.char_run(a, 8)),
            ("questions", X.question_count(a) >= 10),
            ("latin_heavy", in_script & (n_script < 2) & (n_latin >= 16)),
            ("rare_symbols", in_script & (n_script >= 12) & (rare >= 0.08)),
            ("script_share", in_script & (n_script >= 12) & (n_latin > 0) & (X.ratio(n_script, n_script + n_latin) < 0.58)),
            ("keyword_miss", in_script & (F.size(keys) > 0) & ~contains_term(low, keys) & ~((F.length(a) <= 24) & factoid(q, lex))),
            ("repeated_chunk", in_script & X.repeated_chunk(a, script)),
            ("low_diversity", (F.size(words) >= 16) & (X.token_diversity(words) < 0.34)),
            ("solver_style", ~solver_query(q, lex) & (hits >= 2)),
            ("no_overlap", ~in_script & ~solver_query(q, lex) & (F.size(qt) > 0) & (F.size(at) > 0) & ~F.arrays_overlap(qt, at)),
        ]
    )


def low_quality_translation(inp, out, lex: Lexicon = KOREAN) -> Column:
    i, o = F.lower(X.text(inp)), F.lower(X.text(out))
    return (
        has_any(o, lex.noise_hints)
        | (i.contains("given the task definition") & (F.length(o) > 420))
        | (X.count_re(o, "\n") >= 8)
    )


def language_dominance_rules(inp, out, script: Script = HANGUL, lex: Lexicon = KOREAN, min_count: int = 6,
                             min_ratio: float = 0.12, out_script: float = 0.28, out_latin: float = 0.60,
                             lead_max: int = 4, code_topic: str = "javascript|typescript|python|java|react|node|sql|html|css|docker|kubernetes|git") -> list[Rule]:
    """Rejects of rows labelled with the script's language whose output is Latin or code heavy."""
    a, both = X.text(out), merged(inp, out)
    n, r = X.script_count(a, script), X.script_ratio_letters(a, script)
    latin, lr, size = X.count_in(a, "A-Za-z"), X.latin_ratio(a, script), F.length(a)
    return [
        ("ko_weak", (X.script_count(both, script) < min_count) | (X.script_ratio_letters(both, script) < min_ratio)),
        ("ko_code_like", code_like(inp, lex) | code_like(out, lex)),
        ("ko_latin_heavy", (n < 4) & (latin >= 8)),
        ("ko_short_ascii_answer", (size <= 40) & (n <= 1) & a.rlike("[A-Za-z]{3,}")),
        ("ko_output_low_hangul_ratio", (size >= 24) & (r < out_script)),
        ("ko_output_latin_dominant", (size >= 24) & (lr > out_latin)),
        ("ko_ascii_lead", a.rlike(r"\A\s*[A-Za-z][A-Za-z0-9_\-+.#]{2,}") & (n <= lead_max)),
        ("ko_code_topic_dominant", a.rlike(rf"(?i)(?:\A|[^a-z0-9_])(?:{code_topic})(?:[^a-z0-9_]|\z)") & (r < 0.52)),
        ("ko_code_symbol_dominant", (X.code_symbol_ratio(a) > 0.11) & (r < 0.55)),
    ]


def meta_roleplay(inp, out, script: Script = HANGUL, lex: Lexicon = KOREAN) -> Column:
    i, o = X.text(inp), X.text(out)
    both = merged(i, o)
    return (
        both.rlike(ci(lex.meta_prompt_ci))
        | (i.rlike(ci(lex.roleplay_ci)) & (F.length(o) < 80))
        | (o.rlike(ci(lex.cot_style_ci)) & (F.length(o) >= 40))
        | ((X.script_count(both, script) == 0) & (F.length(both) < 40))
    )


def binary_content(c) -> Column:
    s = X.text(c)
    return (s == "") | s.contains("\x00") | (X.binary_ratio(s) > 0.02)


# Named pair rule sets (input bounds, output bounds, repeat limit, script minimum).
PAIR_RULE_SETS = {
    "language_pack": {"inp": (4, 2400), "out": (3, 3200), "run": 14, "script": 0, "questions": 24},
    "quality_pairs": {"inp": (2, 2200), "out": (8, 2600), "run": 10, "script": 8, "questions": None},
    "clean_mix": {"inp": (2, 260), "out": (8, 420), "run": 10, "script": 1, "questions": None},
    "general_balance": {"inp": (2, 320), "out": (8, 640), "run": 12, "script": 2, "questions": None},
    "hq_mix": {"inp": (2, 1800), "out": (4, 2400), "run": 12, "script": 0, "questions": None},
    "focus_pairs": {"inp": (2, 900), "out": (10, 1200), "run": 8, "script": 6, "questions": None},
    "term_anchor": {"inp": (2, 900), "out": (12, 1100), "run": 8, "script": 8, "questions": None},
    "tool_rows": {"inp": (2, 1200), "out": (4, 1800), "run": 8, "script": 4, "questions": None},
    "replay": {"inp": (3, 10**9), "out": (3, 10**9), "run": None, "script": 0, "questions": None},
}


def pair_rules(name: str, inp, out, script: Script = HANGUL) -> Column:
    """True when the pair passes the named rule set."""
    p = PAIR_RULE_SETS[name]
    i, o = X.clean_text(inp), X.clean_text(out)
    bad = outside(i, *p["inp"]) | outside(o, *p["out"]) | i.contains(REPLACEMENT) | o.contains(REPLACEMENT)
    if p["run"] is not None:
        bad = bad | X.char_run(o, p["run"])
    if p["script"]:
        bad = bad | (X.script_count(merged(i, o), script) < p["script"])
    if p["questions"] is not None:
        bad = bad | (X.question_count(i) > p["questions"]) | (X.question_count(o) > p["questions"])
    if name == "replay":
        bad = bad | i.contains("???") | o.contains("???")
    return ~bad


def chat_rules(inp, out, hint: Column, tier, script: Script = HANGUL, allow_mid: bool = False, allow_missing: bool = False,
               inp_len=(2, 1800), out_len=(12, 2400), min_count: int = 6, min_ratio: float = 0.14) -> list[Rule]:
    """Rule order of the chat-quality curation."""
    both = merged(inp, out)
    return [
        ("missing_pair", missing_pair(inp, out)),
        ("input_length", outside(inp, *inp_len)),
        ("output_length", outside(out, *out_len)),
        ("noise", noise_text(both)),
        ("label_only", label_only(out)),
        ("echo", echo(inp, out)),
        ("noisy_output", alnum_floor(out, 8, 14)),
        *tier_reason(tier, allow_mid, allow_missing),
        *language_rules(hint, both, script, min_count, min_ratio),
    ]


def strict_rules(inp, out, hint: Column, script: Script = HANGUL, lex: Lexicon = KOREAN,
                 inp_len=(2, 1800), out_len=(8, 2400), min_count: int = 6, min_ratio: float = 0.12) -> list[Rule]:
    """Rule order of the strict pure-learning build."""
    both = merged(inp, out)
    return [
        ("missing_pair", missing_pair(inp, out)),
        ("input_length", outside(inp, *inp_len)),
        ("output_length", outside(out, *out_len)),
        ("intro_input", X.text(inp).rlike(ci(lex.intro_query_ci))),
        ("banned_output_substring", banned_substrings(out, lex.banned_outputs)),
        ("replacement_char", both.contains(REPLACEMENT)),
        ("repeat_noise", X.char_run(out, 12)),
        ("label_only", label_only(out)),
        ("echo", echo(inp, out)),
        ("noisy_output", alnum_floor(out, 8, 16)),
        ("non_ko", ~hint & ((X.script_count(both, script) < min_count) | (X.script_ratio_letters(both, script) < min_ratio))),
    ]


def general_rules(inp, out, language: Column, script: Script = HANGUL) -> list[Rule]:
    """Rule order of the all-trainable build."""
    return [
        ("no_pair", missing_pair(inp, out)),
        ("corrupt", corrupt_text(inp, language, script) | corrupt_text(out, language, script)),
    ]


def quality_rules(inp, out, script: Script = HANGUL, lex: Lexicon = KOREAN, inp_len=(2, 900), out_len=(12, 1100),
                  min_count: int = 6, min_ratio: float = 0.30) -> list[Rule]:
    """Rule order of the quality build, up to its score."""
    q, a = X.normalize_space(inp), X.normalize_space(out)
    both = merged(q, a)
    words = X.words(a, script, 2)
    return [
        ("missing_pair", missing_pair(q, a)),
        ("input_length", outside(q, *inp_len)),
        ("output_length", outside(a, *out_len)),
        ("encoding_noise", both.contains(REPLACEMENT) | both.contains("???")),
        ("template_leak", template_leak(both, lex)),
        ("char_repeat", X.char_run(both, 8)),
        ("code_like", code_like(both, lex)),
        ("intro_query", q.rlike(ci(lex.intro_query_ci))),
        ("intro_answer", a.rlike(ci(lex.intro_answer_ci))),
        ("meta_style", a.rlike(ci(lex.meta_style_ci))),
        ("ko_weak", (X.script_count(both, script) < min_count) | (X.script_ratio_letters(both, script) < min_ratio)),
        ("keyword_miss", keyword_miss(q, a, script, lex)),
        *answer_shape_rules(q, a, lex),
        ("low_diversity", (F.size(words) >= 14) & (X.token_diversity(words) < 0.32)),
    ]


def definition_question(c, lex: Lexicon = KOREAN) -> Column:
    """Small evaluation set: a definition question of at least three characters."""
    return (F.length(X.strip(c)) >= 3) & ~X.text(c).contains("???") & X.text(c).rlike(ux(lex.definition))
