"""Metrics and predicates on small literal frames, next to plain Python definitions."""

import re

import pytest
from pyspark.sql import functions as F

from pairmill.functions import classify as C
from pairmill.functions import filters as R
from pairmill.functions import score as Q
from pairmill.functions import text as X

# Empty and null, odd blanks, replacement character, question runs, runs of one character, labels,
# mixed scripts, a 20,000-word text, an emoji.
TEXTS = [
    "", None, "   ", "a b\x1fc", " x\n\n\ny ", "bad � text", "what???", "????????", "aaaaaaaaaaaaaaa", "aaaaaaaaab", "A", "3.5",
    "한국어 문장입니다. 두 번째 문장!", "mixed 한글 and latin 123", "가나가나 다라", "가가가가", "word " * 20_000, "emoji 😀 here", "tab\tand  two  spaces",
    "x" * 8, "ㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋ", "{* include me *}", "1.0", "답: 예입니다", "정답은 12.0 이다", "안녕. " * 4, "Ünïcode çase ß",
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, s string").cache()


def values(frame, col):
    return [r[0] for r in frame.orderBy("i").select(col).collect()]


def py(fn):
    return [fn(t or "") for t in TEXTS]


def test_normalize_space(frame):
    assert values(frame, X.normalize_space("s")) == py(lambda t: re.sub(r"\s+", " ", t).strip())


def test_strip(frame):
    assert values(frame, X.strip("s")) == py(str.strip)


def test_clean_text(frame):
    def clean(t):
        t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t.replace("\r\n", "\n").replace("\r", "\n")))
        return t.strip()

    assert values(frame, X.clean_text("s")) == py(clean)


def test_counts_and_ratios(frame):
    assert values(frame, X.script_count("s")) == py(lambda t: len(re.findall("[가-힣]", t)))
    assert values(frame, X.alnum_count("s")) == py(lambda t: sum(c.isalnum() for c in t))

    def ratio(t):
        n = len(re.findall("[A-Za-z가-힣]", t))
        return len(re.findall("[가-힣]", t)) / n if n else 0.0

    assert values(frame, X.script_ratio_letters("s")) == pytest.approx(py(ratio))
    assert values(frame, X.digit_ratio("s")) == pytest.approx(py(lambda t: sum(c.isdigit() for c in t) / len(t) if t else 1.0))
    assert values(frame, X.distinct_chars("s")) == py(lambda t: len(set(t)))
    assert values(frame, X.question_count("s")) == py(lambda t: t.count("?"))


def test_char_run(frame):
    for k in (8, 10, 14):
        assert values(frame, X.char_run("s", k)) == py(lambda t: bool(re.search(r"(.)\1{%d,}" % k, t)))


def test_repetition(frame):
    def bad(t):
        toks = re.findall("[A-Za-z0-9가-힣]+", t.lower())
        if len(toks) < 8:
            return False
        top = max(toks.count(w) for w in set(toks))
        big = [f"{a} {b}" for a, b in zip(toks, toks[1:])]
        return (top >= 4 and top / len(toks) >= 0.24) or max(big.count(b) for b in set(big)) >= 3

    assert values(frame, X.repetition_bad("s")) == py(bad)


def test_repeated_chunk(frame):
    def rep(t):
        s = "".join(re.findall("[가-힣]", t))
        return any(s[i:i + n] == s[i + n:i + 2 * n] and len(set(s[i:i + n])) > 1 for n in (2, 3) for i in range(len(s) - 2 * n + 1))

    assert values(frame, X.repeated_chunk("s")) == py(rep)


def test_sentences(frame):
    got = [list(v) for v in values(frame, X.sentences("s"))]
    assert got == py(lambda t: [p.strip() for p in re.split(r"(?<=[.!?])\s+|\n+", t) if p.strip()])


def test_noise_and_labels(frame):
    def noise(t):
        return "�" in t or "??" in t or bool(re.search(r"(.)\1{10,}", t)) or bool(re.search(r"\{\*[^{}]{0,400}\*\}", t))

    assert values(frame, R.noise_text("s")) == py(noise)
    assert values(frame, R.label_only("s")) == py(lambda t: bool(re.fullmatch(r"\s*(?:[A-D]|[0-9]+(?:\.[0-9]+)?)\s*", t)))
    assert values(frame, R.alnum_floor("s")) == py(lambda t: sum(c.isalnum() for c in t) < max(8, len(t) // 14))


def test_particles(spark):
    toks = ["코틀린이란", "코틀린은", "은", "가은", "파이썬인가요", "사과", "학교에", "입니다"]
    want = ["코틀린", "코틀린", "은", "가은", "파이썬", "사과", "학교", "입니다"]
    d = spark.createDataFrame(list(enumerate(toks)), "i int, s string")
    assert values(d, X.strip_particle(F.col("s"))) == want


def test_normalize_answer(spark):
    cases = [("답: 예입니다", "예"), ("정답은 12.0", "12"), ("생각\n최종답: 1,200", "1200"), ("모르겠다", "알 수 없음"), ("b", "B"), ("", ""), ("`답: 아니오`", "아니오"), ("보장할 수 없다.", "알 수 없음")]
    d = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, s string")
    assert values(d, Q.normalize_answer("s")) == [w for _, w in cases]


def test_first_reason_keeps_rule_order(spark):
    d = spark.createDataFrame([(0, "", "x"), (1, "A?", "A"), (2, "코틀린 설명", "코틀린은 정적 타입 프로그래밍 언어입니다."), (3, "same text here ok", "Same  text here ok")], "i int, q string, a string")
    rules = R.chat_rules("q", "a", F.lit(True), F.lit("high"))
    assert values(d, R.first_reason(rules)) == ["missing_pair", "output_length", None, "echo"]


def test_field_classify(spark):
    paths = ["a/hq_ko_chat.jsonl", "x/quality/hq_ko_chat_v1.jsonl", "m.manifest.json", "code_chat_ko.jsonl", "zzz.jsonl"]
    d = spark.createDataFrame(list(enumerate(paths)), "i int, s string")
    got = values(d, C.classify_field("s", F.lit(0.0), F.lit(0.9), F.lit(0.9))["field"])
    assert got == ["ko_chat_general", "quality_curated", "profile_meta", "coding_tech", "ko_chat_general"]


def test_file_language_and_extension(spark):
    d = spark.createDataFrame([(0, "src/A.PY"), (1, "b.tsx"), (2, "noext"), (3, "x.tar.gz")], "i int, s string")
    assert values(d, C.language_of_path("s")) == ["Python", "TSX", "Unknown", "Unknown"]


def test_counts_of_tokens_in_batches(spark):
    from pairmill.functions.counts import most_frequent, repeats

    rows = [(1, ["b", "a", "b", "a", "c"]), (2, []), (3, ["x"]), (4, ["z", "y", "y", "z", "z", "y", "z"])]
    d = spark.createDataFrame(rows, "i long, k array<string>").repartition(1)
    got = {r["i"]: (r["m"], r["r"]) for r in d.select("i", most_frequent(F.col("k"), 2).alias("m"), repeats(F.col("k")).alias("r")).collect()}
    assert got == {1: (["b", "a"], [5, 2, 2]), 2: ([], [0, 0, 0]), 3: (["x"], [1, 1, 0]), 4: (["z", "y"], [7, 4, 2])}


def test_counts_without_a_class(spark):
    rows = [(None, 0, 0), ("", 0, 0), ("a b\u00a0\t1", 3, 3), ("\U0001f600 é—\U0001d7d8", 4, 2), ("  ..  ", 2, 0)]
    d = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string")
    got = {r["i"]: (r["n"], r["a"]) for r in d.select("i", X.count_without("t", f" {X.ODD_BLANK}").alias("n"), X.alnum_count("t").alias("a")).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}


def test_repetition_finds_tokens_once(spark):
    d = spark.range(1).select(F.lit("a b a b a b c d").alias("t")).select(X.repetition_bad("t").alias("r"))
    assert d._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1


def test_answers_of_one_item_are_not_dealt_out_by_it(spark):
    from pairmill.operators import joins as J

    a = spark.createDataFrame([("x", "yes")] * 10, "id string, stdout string")
    d = J.with_expectations(a, J.expectation_frame(spark, {"x": {"all": ["yes"]}}))
    assert "BroadcastHashJoin" in d._jdf.queryExecution().sparkPlan().toString() and d.filter("matches").count() == 10
