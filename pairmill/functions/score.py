"""Scores of rows, answers and terms as Column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairmill.functions import filters as R
from pairmill.functions import text as X
from pairmill.functions.lexicon import KOREAN, Lexicon
from pairmill.schema import HANGUL, Script


def row_weight(rules: Sequence[tuple[Column, int]], cap: int) -> Column:
    """1 plus the weight of every rule that holds, at most ``cap``."""
    w = F.lit(1)
    for cond, add in rules:
        w = w + F.when(cond, add).otherwise(0)
    return F.least(w, F.lit(cap))


def term_answer_score(term, answer, script: Script = HANGUL) -> list[Column]:
    """(contains the term, script symbols, closeness to 80 characters), compared in this order."""
    a, k = F.lower(X.text(answer)), F.lower(X.text(term))
    return [
        F.when((k != "") & F.contains(a, k), 1).otherwise(0),
        X.script_count(answer, script),
        -F.abs(F.length(X.text(answer)) - 80),
    ]


# ------------------------------------------------------------------ terms

DEFINITION_END = "이란\\??$|란\\??$|무엇|뭐야|정의|설명해"  # fixed value


def definition_term(c, script: Script = HANGUL, ending: str = DEFINITION_END) -> Column:
    """Term of a definition question: last token before the question words, particle stripped."""
    s = X.normalize_space(c)
    head = F.regexp_extract(s, rf"\A(.+?)(?:{ending})", 1)
    src = F.when(head == "", s).otherwise(head)
    toks = F.regexp_extract_all(src, F.lit(f"[{script.token}]{{2,}}"), F.lit(0))
    last = F.when(F.size(toks) > 0, F.element_at(toks, -1)).otherwise("")
    return X.strip_particle(F.lower(last), script)


def term_usable(c, script: Script = HANGUL) -> Column:
    t = X.normalize_space(c)
    n, latin = X.script_count(t, script), X.count_in(t, "A-Za-z")
    junk = F.lower(t).rlike(r"\A0x[0-9a-f]+\z") | t.rlike(r"(?U)\A[\W_]+\z") | t.rlike(r"\A[0-9.\-_/]+\z")
    return F.length(t).between(2, 48) & ~junk & (n + latin > 0) & ~((latin > 0) & (n == 0) & (F.length(t) < 3))


def clean_answer(c, script: Script = HANGUL, max_chars: int = 220) -> Column:
    """Tags removed, cut to the first sentence; '' when noisy or too short."""
    s = X.strip_tags(c)
    noisy = s.contains(R.REPLACEMENT) | (X.question_count(s) >= F.greatest(F.lit(3), F.floor(F.length(s) / 18)))
    cut = X.first_sentence(s, max_chars)
    weak = (F.length(cut) < 12) | ((X.script_count(cut, script) < 2) & (X.count_in(cut, "A-Za-z") < 8))
    return F.when(noisy | weak, "").otherwise(cut)


def term_source_score(term, answer, source, priority: dict[str, int]) -> list[Column]:
    """(source priority by file name, closeness of the term to six characters, shorter answer)."""
    name = F.lower(F.element_at(F.split(X.text(source), r"[\\/]"), -1))
    p = F.lit(0)
    for k, v in priority.items():
        p = F.when(name == k, v).otherwise(p)
    return [p, -F.abs(F.length(X.text(term)) - 6), -F.length(X.text(answer))]


# ------------------------------------------------------------------ rows


def tier_bonus(tier) -> Column:
    t = F.lower(X.strip(tier))
    return F.when(t == "high", 0.45).when(t == "mid", 0.20).otherwise(0.0)


def quality_score(inp, out, tier, script: Script = HANGUL, lex: Lexicon = KOREAN) -> Column:
    q, a = X.normalize_space(inp), X.normalize_space(out)
    qt, at = X.keyword_terms(q, script, lex.fillers), X.keyword_terms(a, script, lex.fillers)
    share = X.ratio(F.size(F.array_intersect(qt, at)), F.size(qt))
    return (
        F.least(F.length(a), F.lit(260)) / 260.0
        + 0.9 * X.script_ratio_letters(R.merged(q, a), script)
        + 1.1 * share
        + tier_bonus(tier)
        + F.when(q.rlike(R.ux(lex.logic)) & a.rlike(R.ux(lex.reason_words)), 0.30).otherwise(0.0)
        + F.when(q.rlike(R.ux(lex.math)) & a.rlike(r"\d"), 0.22).otherwise(0.0)
        + F.when(q.rlike(R.ux(lex.syllogism)) & a.rlike(R.ux(lex.syllogism_score_words)), 0.22).otherwise(0.0)
    )


def vocab_sample_weight(score: Column, overlap: Column, tier: Column, boost: float = 0.55) -> Column:
    w = 1.0 + boost * score + F.when(overlap > 0, 0.18).otherwise(0.0)
    w = w + F.when(tier == "high", 0.22).when(tier == "mid", 0.10).otherwise(0.0)
    return F.greatest(F.lit(0.05), w)


def tier_uplift(tier, hits: Column, overlap: Column) -> Column:
    up = F.when((hits >= 2) | ((hits >= 1) & (overlap > 0)), 2).when(hits >= 1, 1).otherwise(0)
    return X.rank_to_tier(F.greatest(X.tier_rank(tier), up.cast("long")))


# ------------------------------------------------------------------ answers


def alignment_bonus(inp, out, script: Script = HANGUL, lex: Lexicon = KOREAN, ending: str = DEFINITION_END) -> Column:
    q, r = X.strip(inp), X.strip(out)
    t = F.lower(definition_term(q, script, ending))
    asks = q.rlike(R.ux(lex.definition)) & (t != "")
    close = X.best_term_similarity(t, r, script) >= 0.84
    d = F.when(~asks, 0.0).when(F.contains(F.lower(r), t), 1.20).when(close, 0.45).otherwise(-1.45)
    g = F.when(~q.rlike(R.ux(lex.logic)), 0.0).when(r.rlike(R.ux(lex.reason_words)), 0.45).otherwise(-0.60)
    i = F.when(r.rlike(R.ci(lex.intro_answer_ci)) & ~q.rlike(R.ci(lex.intro_query_ci)), -1.0).otherwise(0.0)
    return F.when(r == "", -1.5).otherwise(d + g + i)


def relevance_score(inp, out, rare: Column, script: Script = HANGUL, lex: Lexicon = KOREAN) -> Column:
    q, r = X.strip(inp), X.strip(out)
    qt, rt = X.retrieval_tokens(q, script), X.retrieval_tokens(r, script)
    inter = F.size(F.array_intersect(qt, rt))
    both = (F.size(qt) > 0) & (F.size(rt) > 0)
    keys = X.keyword_terms(q, script, lex.fillers)
    hit = F.size(F.filter(keys, lambda k: F.contains(F.lower(r), k)))
    s = (
        F.least(F.length(r), F.lit(240)) / 240.0
        + F.when(both, 2.0 * inter / F.size(qt) + 1.0 * inter / F.greatest(F.lit(1), F.size(qt) + F.size(rt) - inter)).otherwise(0.0)
        + F.when(R.solver_query(q, lex) & r.rlike(r"\d"), 0.5).otherwise(0.0)
        + F.when(F.size(keys) > 0, 0.9 * hit / F.size(keys) - F.when((hit == 0) & ~R.factoid(q, lex), 0.8).otherwise(0.0)).otherwise(0.0)
        - F.when(X.char_run(r, 8), 2.0).otherwise(0.0)
        - F.when(X.script_count(q, script) > 0, 1.75 * rare).otherwise(0.0)
    )
    return F.when(r == "", -1.0).otherwise(s)


def simple_words(c, script: Script = HANGUL) -> Column:
    """Distinct lower-case words of two or more letters, digits or underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(X.text(c)), F.lit(f"[{script.token}_]{{2,}}"), F.lit(0)))


def soft_judge(target, response, script: Script = HANGUL) -> Column:
    t, r = X.strip(target), X.strip(response)
    tn, rn = F.lower(X.normalize_space(t)), F.lower(X.normalize_space(r))
    inside = F.contains(rn, F.substring(tn, 1, 48)) | F.contains(tn, F.substring(rn, 1, 48))
    size = F.least(F.length(t), F.length(r)) / F.greatest(F.length(t), F.length(r), F.lit(1)).cast("double")
    s = 0.55 * X.jaccard(simple_words(t, script), simple_words(r, script)) + F.when(inside, 0.25).otherwise(0.0) + 0.20 * size
    return F.when((t == "") | (r == ""), 0.0).otherwise(s)


def objective(hard: Column, soft: Column) -> Column:
    return F.when(hard, 2.0).otherwise(0.0) + soft


def verify(kind: Column, required: Column, pattern: Column, target, response) -> Column:
    """struct(ok, reason) of an exact, contains-all or regex verifier."""
    r = F.lower(X.normalize_space(response))
    missing = F.filter(F.transform(required, lambda x: F.lower(X.strip(x))), lambda x: ~F.contains(r, x))
    exact = r == F.lower(X.normalize_space(target))
    found = F.regexp_like(X.text(response), pattern)

    def out(ok, reason):
        return F.struct(ok.alias("ok"), F.when(ok, "").otherwise(reason).alias("reason"))

    k = F.lower(X.strip(kind))
    return (
        F.when(k == "exact", out(exact, F.lit("exact_mismatch")))
        .when(k == "contains", out(F.size(missing) == 0, F.concat(F.lit("missing:"), F.array_join(F.slice(missing, 1, 4), ","))))
        .when((k == "regex") & (F.coalesce(pattern, F.lit("")) == ""), out(F.lit(False), F.lit("empty_regex")))
        .when(k == "regex", out(found, F.lit("regex_mismatch")))
    )


# Answer marks, sentence endings and canonical short answers.
ANSWER_MARK = r"(?i)(?:최종답|정답|답|결론)\s*(?::|은)\s*([^\n]+)"
ENDINGS = r"(?:입니다|이다|임)\z"
YES = ("예", "네", "맞다", "맞음", "yes")
NO = ("아니오", "아니다", "아님", "no")
UNKNOWN = ("알수없음", "모름", "모르겠다", "보장할수없다", "판단불가", "unknown")


def has_explicit_answer(c) -> Column:
    return X.text(c).rlike(ANSWER_MARK)


def normalize_answer(c) -> Column:
    """Last explicit answer, else the last line; endings, commas and blanks dropped; canonical yes/no/unknown."""
    s = F.regexp_replace(X.strip(c), "\r", "\n")
    marks = F.regexp_extract_all(s, F.lit(ANSWER_MARK), F.lit(1))
    lines = F.filter(F.transform(F.split(s, "\n"), X.strip), lambda x: x != "")
    pick = F.when(F.size(marks) > 0, X.strip(F.element_at(marks, -1))).when(F.size(lines) > 0, F.element_at(lines, -1)).otherwise("")
    a = X.strip(F.regexp_replace(X.strip(pick), r"\A`+|`+\z", ""))
    a = X.strip(F.regexp_replace(a, ENDINGS, ""))
    a = X.strip(F.regexp_replace(a, r"\A\.+|\.+\z", ""))
    a = F.replace(F.replace(a, F.lit(" "), F.lit("")), F.lit(","), F.lit(""))
    low = F.lower(a)
    return (
        F.when(low.isin(*YES), "예").when(low.isin(*NO), "아니오").when(low.isin(*UNKNOWN), "알 수 없음")
        .when(low.rlike(r"\A-?\d+\.0+\z"), F.substring_index(low, ".", 1))
        .when(low.rlike(r"\A[a-d]\z"), F.upper(low)).otherwise(a)
    )


def case_score(prompt, response, expect: Column, min_chars: Column, expect_unknown: Column, discourage_intro: Column,
               script: Script = HANGUL, lex: Lexicon = KOREAN) -> Column:
    """struct(score, reasons) of one evaluation case, score clipped to [0, 1]."""
    r = X.strip(response)
    q, a = X.keyword_terms(prompt, script), X.keyword_terms(r, script)
    shared = F.size(F.array_intersect(q, a))
    hits = F.size(F.filter(expect, lambda x: F.contains(F.lower(r), F.lower(x))))
    unknown, intro, run = r.rlike(R.ux(lex.unknown)), r.rlike(R.ci(lex.intro_answer_ci)), X.char_run(r, 8)
    words = X.words(r, script, 2)
    dull = (F.size(words) >= 14) & (X.token_diversity(words) < 0.34)
    rich = X.script_ratio_alnum(r, script) >= 0.55
    s = (
        F.when(F.length(r) >= min_chars, 0.15).otherwise(0.0)
        + F.when(rich, 0.15).otherwise(0.0)
        + F.when(F.size(q) > 0, 0.20 * shared / F.size(q)).otherwise(0.0)
        + F.when(F.size(expect) > 0, 0.40 * hits / F.size(expect)).otherwise(0.0)
        + F.when(expect_unknown & unknown, 0.20).when(~expect_unknown & unknown, -0.20).otherwise(0.0)
        - F.when(discourage_intro & intro, 0.30).otherwise(0.0)
        - F.when(run, 0.25).otherwise(0.0)
        - F.when(dull, 0.20).otherwise(0.0)
    )
    reasons = F.filter(
        F.array(
            F.when(F.length(r) < min_chars, "too_short"),
            F.when(~rich, "low_hangul_ratio"),
            F.when((F.size(q) > 0) & (shared == 0), "no_keyword_overlap"),
            F.when((F.size(expect) > 0) & (hits == 0), "expected_terms_missing"),
            F.when(expect_unknown & ~unknown, "should_be_unknown"),
            F.when(~expect_unknown & unknown, "unexpected_unknown"),
            F.when(discourage_intro & intro, "intro_leak"),
            F.when(run, "char_repeat"),
            F.when(dull, "low_diversity"),
        ),
        lambda x: x.isNotNull(),
    )
    empty = F.struct(F.lit(0.0).alias("score"), F.array(F.lit("empty")).alias("reasons"))
    return F.when(r == "", empty).otherwise(F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)).alias("score"), reasons.alias("reasons")))


# Characters of a normal short answer, arithmetic marks, unknown marks, expected terms.
ANSWER_CHARS = r" \t\n\r0-9A-Za-z{script},?!:;()\-_/\"'~`"
ARITHMETIC_MARKS = ("최종답", "정답:", "부분곱", "검산", "일의 자리", "십의 자리")
UNKNOWN_MARKS = ("모르겠습니다", "확실하지 않", "알 수 없습니다")
GENERAL_EXPECTATIONS = {
    "chat_hi": {"any": ["안녕", "반갑", "하이"], "max_len": 80},
    "chat_intro": {"any": ["안녕", "반갑", "도움", "설명", "정리"], "max_len": 180},
    "chat_help": {"any": ["도움", "설명", "정리", "질문"], "max_len": 180},
    "def_kotlin": {"all": ["코틀린"], "any": ["언어", "프로그래밍", "jvm", "안드로이드"], "max_len": 260},
    "def_http": {"all": ["http"], "any": ["프로토콜", "웹", "요청", "응답"], "max_len": 260},
    "def_jwt": {"all": ["jwt"], "any": ["토큰", "인증", "서명"], "max_len": 260},
    "def_gc": {"any": ["메모리", "가비지", "회수", "정리"], "max_len": 260},
    "qa_sla99": {"all": ["99"], "any": ["가용성", "서비스", "업타임", "수준"], "max_len": 260},
    "qa_vienna": {"any": ["조리", "가열", "먹", "안전", "식품"], "max_len": 260},
}
LOGIC_EXPECTATIONS = {
    "logic_compare": {"any": ["a", "b", "c"]},
    "logic_compare_smallest": {"any": ["a", "b", "c", "d"]},
    "logic_prob": {"any": ["/", "확률", "2/5", "3/5", "4/5", "5/8", "6/7"]},
    "logic_prob_blue": {"any": ["/", "확률", "2/5", "3/5", "4/5", "5/8", "6/7"]},
    "logic_seq": {"any": ["규칙", "다음", "알 수 없음", "단정", "44", "71", "192"]},
    "logic_sequence": {"any": ["규칙", "다음", "알 수 없음", "단정", "44", "71", "192"]},
    "logic_syllogism_yes": {"any": ["예", "아니", "참", "보장", "가능"]},
    "logic_syllogism_unknown": {"any": ["예", "아니", "보장", "없", "불가"]},
}
DEFINITION_TERMS = {
    "def_kotlin": ("코틀린", "언어"),
    "def_http": ("http", "프로토콜", "요청", "응답"),
    "def_jwt": ("jwt", "토큰", "인증"),
    "def_gc": ("메모리", "회수", "가비지"),
    "qa_sla99": ("99", "가용성", "서비스"),
}


def is_general_item(item) -> Column:
    return X.text(item).rlike(r"\A(?:chat_|def_|qa_)")


def is_logic_item(item) -> Column:
    return X.text(item).startswith("logic_")


def collapse_flag(item, c, matches: Column, script: Script = HANGUL) -> Column:
    """Broken stored answer: empty, arithmetic marks, long numbers, odd characters, repetition, wrong script or
    missed expectations."""
    s = X.normalize_space(c)
    odd = X.count_in(s, "^" + ANSWER_CHARS.format(script=script.symbols))
    return (
        (s == "")
        | R.has_any(s, ARITHMETIC_MARKS)
        | s.rlike(r"\d{4,}")
        | ((F.length(s) >= 12) & (X.distinct_chars(s) <= 3))
        | (X.ratio(odd, F.length(s)) > 0.08)
        | (X.digit_ratio(s) > 0.22)
        | X.repetition_bad(s, script, min_tokens=6, share=0.22)
        | (is_general_item(item) & (X.script_count(s, script) == 0))
        | ((is_general_item(item) | is_logic_item(item)) & ~matches)
    )


def definition_relevance(item, c) -> Column:
    """Share of the expected terms found; null for other items."""
    low = F.lower(X.normalize_space(c))
    out = F.lit(None).cast("double")
    for k, words in DEFINITION_TERMS.items():
        n = F.lit(0)
        for w in words:
            n = n + F.contains(low, F.lit(w)).cast("int")
        out = F.when(X.text(item) == k, n / float(len(words))).otherwise(out)
    return out


def probe_penalty(c) -> Column:
    s = X.strip(c)
    w = F.regexp_extract_all(F.lower(s), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    dull = (F.size(w) >= 12) & (X.token_diversity(w) < 0.34)
    return F.when(s == "", 1.0).when(X.char_run(s, 8), 0.8).when(dull, 0.55).otherwise(0.0)


def _hits(c: Column, words: Sequence[str]) -> Column:
    n = F.lit(0)
    for w in words:
        n = n + F.contains(c, F.lit(w)).cast("int")
    return n


def probe_score(expect, c) -> Column:
    """Score of a stored probe output for the expectations code, math or general."""
    s = X.strip(c)
    size = F.least(F.length(s), F.lit(120)) / 120.0
    code = F.least(F.lit(1.0), _hits(s, ("def ", "return ", "```", "lambda ", "function ")) / 2.0)
    has = F.when(s.rlike(r"(?U)\b120\b"), 1.0).otherwise(0.0)
    digit = F.when(s.rlike(r"\d"), 1.0).otherwise(0.0)
    n_words = F.size(F.filter(F.split(X.normalize_space(s), " "), lambda x: x != ""))
    sent = F.when(s.contains(".") | s.contains(";") | (n_words >= 8), 1.0).otherwise(0.0)
    raw = (
        F.when(X.text(expect) == "code", 0.60 * code + 0.40 * size)
        .when(X.text(expect) == "math", 0.75 * has + 0.25 * digit)
        .otherwise(0.55 * sent + 0.45 * size)
    )
    return F.greatest(F.lit(0.0), raw - probe_penalty(s))


def gate_code_score(c) -> Column:
    hints = ("```", "def ", "class ", "print(", "function ", "return ", "for ", "while ")
    return F.least(F.lit(1.0), _hits(F.lower(X.text(c)), hints) / 2.0)


def gate_ops_score(c, words: Sequence[str] = ("체크", "점검", "로그", "학습", "손실", "검증", "데이터", "체크리스트")) -> Column:
    return F.least(F.lit(1.0), _hits(X.text(c), words) / 2.0)


def rule_candidates(prompt, target, response, reason) -> Column:
    """Three candidate rule texts of one failure, as array<struct(pos, text)>."""
    t, p, r = X.trim_ellipsis(target, 220), X.trim_ellipsis(prompt, 120), X.trim_ellipsis(response, 120)
    why = F.when(X.strip(reason) == "", "verification_failed").otherwise(X.strip(reason))
    texts = (
        F.concat(F.lit("If the query is similar to: "), p, F.lit("\nReturn content aligned with: "), t),
        F.concat(F.lit("Rule from failure("), why, F.lit("): prioritize target constraints.\nTarget anchor: "), t),
        F.concat(F.lit("Fix incorrect output pattern.\nBad output snippet: "), r, F.lit("\nExpected style/content: "), t),
    )
    return F.array(*[F.struct(F.lit(i).alias("pos"), x.alias("text")) for i, x in enumerate(texts)])


def best_rule(prompt, target, response, reason, script: Script = HANGUL) -> Column:
    """struct(score, text): 0.75 overlap with the target + 0.25 with the reason - 0.001 per character over 260."""
    tt, rt = simple_words(target, script), simple_words(reason, script)

    def score(x):
        w = simple_words(x["text"], script)
        s = 0.75 * X.jaccard(w, tt) + 0.25 * X.jaccard(w, rt) - 0.001 * F.greatest(F.lit(0), F.length(x["text"]) - 260)
        return F.struct(F.round(s, 9).alias("score"), (-x["pos"]).alias("np"), x["text"].alias("text"))

    return F.array_max(F.transform(rule_candidates(prompt, target, response, reason), score))
