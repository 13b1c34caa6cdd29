"""Extraction and augmentation: new task rows from existing rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.functions import classify as C
from pairmill.functions import filters as R
from pairmill.functions import score as Q
from pairmill.functions import text as X
from pairmill.functions.counts import most_frequent
from pairmill.functions.lexicon import KOREAN, Lexicon
from pairmill.operators.sample import order_key, uniform
from pairmill.schema import HANGUL, Script

LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` over a value computed once per row (a lambda variable is never re-evaluated)."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def lines(c) -> Column:
    return F.transform(F.split(X.text(c), LINE_ENDS), X.strip)


# Line patterns of imports and declarations, control words, stop words.
IMPORT_LINE = (
    r"\A(?:import\s+.+|from\s+.+\s+import\s+.+|use\s+.+|#include\s+.+|(?:const|let|var)\s+\w+\s*=\s*require\(.+\)|"
    r"require\(.+\)|using\s+.+)"
)
SIGNATURE_LINE = (
    r"\A(?:(?:def|class)\s+\w+|(?:export\s+)?(?:async\s+)?function\s+\w+|(?:export\s+)?class\s+\w+|"
    r"(?:pub\s+)?(?:async\s+)?fn\s+\w+|func\s+\w+|(?:public|private|protected|internal)\s+.+\(|"
    r"(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\(.+\)\s*=>)"
)
CONTROL_LINE = r"(?i)\A(?:if |for |while |switch |catch |return )"
STOPWORDS = (
    "the", "and", "for", "with", "that", "this", "from", "into", "your", "you", "are", "was", "were", "have", "has", "had",
    "not", "can", "will", "its", "about", "http", "https", "www", "com",
    "있습니다", "합니다", "그리고", "또한", "으로", "에서", "하는", "대한", "위한", "있는", "없는",
)
CODE_WORDS = (
    "import", "from", "const", "let", "var", "return", "class", "def", "function", "public", "private", "protected", "internal",
    "async", "await", "new", "this", "true", "false", "null", "undefined",
)
WORD = "[A-Za-z{script}_][A-Za-z0-9_+#.\\-]{{1,40}}"


def import_lines(c, n: int = 14) -> Column:
    keep = F.filter(lines(c), lambda x: (F.length(x) <= 220) & x.rlike(R.ux(IMPORT_LINE)))
    return F.slice(F.array_distinct(keep), 1, n)


def signature_lines(c, n: int = 14) -> Column:
    def ok(x):
        brace = x.contains("(") & x.contains(")") & x.endswith("{")
        return (F.length(x).between(1, 240)) & ~x.rlike(CONTROL_LINE) & (x.rlike(R.ux(SIGNATURE_LINE)) | brace)

    return F.slice(F.array_distinct(F.filter(lines(c), ok)), 1, n)


def identifiers(c, n: int = 12, script: Script = HANGUL) -> Column:
    toks = F.regexp_extract_all(X.text(c), F.lit(WORD.format(script=script.symbols)), F.lit(0))
    drop = STOPWORDS + CODE_WORDS
    keep = F.filter(toks, lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(*drop) & ~t.rlike(r"\A[0-9_]+\z"))
    return most_frequent(keep, n)


def keywords(c, n: int = 6, script: Script = HANGUL) -> Column:
    toks = F.regexp_extract_all(F.lower(X.text(c)), F.lit(WORD.format(script=script.symbols)), F.lit(0))
    return most_frequent(F.filter(toks, lambda t: ~t.isin(*STOPWORDS)), n)


def longest_keywords(*cols, n: int = 14, script: Script = HANGUL) -> Column:
    """Union of words, longest first, then by text."""
    words = F.array_distinct(F.flatten(F.array(*[Q.simple_words(c, script) for c in cols])))
    s = F.sort_array(F.transform(words, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
    return F.transform(F.slice(s, 1, n), lambda x: x["w"])


def pick_summary(c, max_sentences: int = 2, max_chars: int = 340, min_chars: int = 25) -> Column:
    """Leading sentences of at least ``min_chars`` until the count or the size is reached."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("stop"))

    def step(a, p):
        size = F.length(a["out"]) + F.length(p) + F.when(a["n"] > 0, 1).otherwise(0)
        skip = (F.length(p) < min_chars) | a["stop"] | (a["n"] >= max_sentences)
        over = ~skip & (size > max_chars)
        out = F.when(skip | over, a["out"]).when(a["n"] > 0, F.concat_ws(" ", a["out"], p)).otherwise(p)
        return F.struct(out.alias("out"), F.when(skip | over, a["n"]).otherwise(a["n"] + 1).alias("n"), (a["stop"] | over).alias("stop"))

    return F.aggregate(X.sentences(c), start, step, lambda a: a["out"])


def keyword_sentence(c, keyword: Column, min_chars: int = 20) -> Column:
    def find(k):
        return F.get(F.filter(X.sentences(c), lambda s: (F.length(s) >= min_chars) & F.contains(F.lower(s), k)), F.lit(0))

    return F.coalesce(bind(F.lower(keyword), find), F.lit(""))


def heading(c) -> Column:
    """First '#' line of 3 to 120 characters that does not read like running text."""
    heads = F.filter(lines(c), lambda x: x.startswith("#"))
    names = F.transform(heads, lambda x: X.strip(F.regexp_replace(x, r"\A#+", "")))
    ok = F.filter(names, lambda h: F.length(h).between(3, 120) & ~((F.length(h) - F.length(F.replace(h, F.lit("."), F.lit(""))) > 1) & (F.length(h) > 60)))
    return F.coalesce(F.get(ok, F.lit(0)), F.lit(""))


# ------------------------------------------------------------------ fan-out

# Prompts of the derived tasks.
CONTINUE_CODE = ("Continue the source file naturally. Preserve style and behavior.",
                 "Continue the following source code in the same style and behavior.")
TASK_PROMPTS = {
    "continuation_rephrase_v2": CONTINUE_CODE[1] + "\n\n",
    "extract_imports_v2": "Extract only the import/dependency declaration lines from the code below. Return one line per declaration.\n\n",
    "extract_signatures_v2": "Extract only function/class declaration lines from the code below. Return one line per declaration.\n\n",
    "identify_language_v1": "Identify the primary programming language of this code snippet in one word.\n\n",
    "classify_role_v1": "Classify the role of this code into one label from: test, frontend, cli, algorithm, config, docs, library.\n\n",
    "extract_identifiers_v1": "List 10 important identifier names from this code, separated by commas.\n\n",
    "ko_summary_extract_v2": "다음 문서를 2문장 이내로 요약해줘.\n\n",
    "ko_keywords_extract_v2": "다음 문서의 핵심 키워드 6개를 쉼표로 출력해줘.\n\n",
    "ko_sentence_extract_v1": "다음 문서에서 '{keyword}'와 직접 관련된 문장 하나를 그대로 찾아줘.\n\n",
    "ko_title_extract_v1": "다음 문서의 제목을 한 줄로 답해줘.\n\n",
}
TASK_SHARE = {
    "continuation_rephrase_v2": 0.25, "extract_imports_v2": 0.55, "extract_signatures_v2": 0.55, "identify_language_v1": 0.50,
    "classify_role_v1": 0.50, "extract_identifiers_v1": 0.45, "ko_summary_extract_v2": 1.0, "ko_keywords_extract_v2": 1.0,
    "ko_sentence_extract_v1": 0.65, "ko_title_extract_v1": 0.70,
}


def _task(kind: str, inp: Column, out: Column, ok: Column, seed, key: str) -> Column:
    share = TASK_SHARE[kind]
    keep = ok if share >= 1.0 else ok & (uniform(order_key(seed, F.lit(kind), key)) < share)
    return F.when(keep, F.struct(F.lit(kind).alias("aug_type"), inp.alias("input"), out.alias("output")))


def _fan_out(df: DataFrame, tasks: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    rows = F.explode(F.filter(F.array(*tasks), lambda t: t.isNotNull()))
    return df.select(*keep, rows.alias("_t")).select(*keep, "_t.*")


def code_tasks(df: DataFrame, key: str, path: str, inp: str, out: str, seed) -> DataFrame:
    """Up to six task rows per code pair, each kept with its own probability."""
    d = df.withColumn("_full", F.concat(X.strip(inp), F.lit("\n"), X.strip(out))).filter((X.strip(inp) != "") & (X.strip(out) != ""))
    d = d.withColumns({"_snip": X.clean_text("_full", 2800), "_imp": import_lines("_full"), "_sig": signature_lines("_full"), "_ids": identifiers("_full")})
    lang = C.language_of_path(path)
    P = TASK_PROMPTS
    t = [
        _task("continuation_rephrase_v2", F.concat(F.lit(P["continuation_rephrase_v2"]), F.substring(X.strip(inp), 1, 1800)), X.strip(out), F.lit(True), seed, key),
        _task("extract_imports_v2", F.concat(F.lit(P["extract_imports_v2"]), "_snip"), F.array_join("_imp", "\n"), F.size("_imp") > 0, seed, key),
        _task("extract_signatures_v2", F.concat(F.lit(P["extract_signatures_v2"]), "_snip"), F.array_join("_sig", "\n"), F.size("_sig") > 0, seed, key),
        _task("identify_language_v1", F.concat(F.lit(P["identify_language_v1"]), "_snip"), lang, lang != "Unknown", seed, key),
        _task("classify_role_v1", F.concat(F.lit(P["classify_role_v1"]), "_snip"), C.code_role(path, "_full"), F.lit(True), seed, key),
        _task("extract_identifiers_v1", F.concat(F.lit(P["extract_identifiers_v1"]), "_snip"), F.array_join(F.slice("_ids", 1, 10), ", "), F.size("_ids") >= 5, seed, key),
    ]
    return _fan_out(d, t, [key])


def document_tasks(df: DataFrame, key: str, text: str, seed, script: Script = HANGUL) -> DataFrame:
    """Up to four task rows per document: summary, keywords, keyword sentence, title."""
    d = df.withColumn("_full", X.strip(F.substring(X.strip(text), 1, 2600))).filter(F.length("_full") >= 180)
    d = d.withColumns({"_sum": pick_summary("_full"), "_kw": keywords("_full", 6, script), "_head": heading("_full")})
    k0 = F.coalesce(F.get("_kw", F.lit(0)), F.lit(""))
    d = d.withColumn("_sent", F.when(k0 == "", "").otherwise(keyword_sentence("_full", k0)))
    P = TASK_PROMPTS
    ask = F.replace(F.lit(P["ko_sentence_extract_v1"]), F.lit("{keyword}"), k0)
    t = [
        _task("ko_summary_extract_v2", F.concat(F.lit(P["ko_summary_extract_v2"]), "_full"), F.col("_sum"), F.length("_sum") >= 40, seed, key),
        _task("ko_keywords_extract_v2", F.concat(F.lit(P["ko_keywords_extract_v2"]), "_full"), F.array_join("_kw", ", "), F.size("_kw") >= 4, seed, key),
        _task("ko_sentence_extract_v1", F.concat(ask, "_full"), F.col("_sent"), F.length("_sent") >= 20, seed, key),
        _task("ko_title_extract_v1", F.concat(F.lit(P["ko_title_extract_v1"]), "_full"), F.col("_head"), F.col("_head") != "", seed, key),
    ]
    return _fan_out(d, t, [key])


KO_CONTINUE_CODE = "다음 소스 코드를 자연스럽게 이어서 완성하세요. 스타일과 동작을 유지하세요."  # fixed value


def continuation_pairs(df: DataFrame, keys: Sequence[str], c: str, min_chars: int = 260, max_chars: int = 60_000) -> DataFrame:
    """File cut at 55 percent, at least 140 characters per side, asked for in two languages."""
    from pairmill.operators.dialog import cut_at

    s = X.strip(F.regexp_replace(X.text(c), r"\r\n?", "\n"))
    d = df.withColumn("_s", s).filter(F.length("_s").between(min_chars, max_chars))
    left, right = cut_at(F.col("_s"), 0.55, 140)
    d = d.select(*keys, left.alias("_l"), right.alias("_r")).filter((F.length("_l") >= 120) & (F.length("_r") >= 120))
    prompts = F.array(F.struct(F.lit("en").alias("language"), F.lit(CONTINUE_CODE[0]).alias("p")), F.struct(F.lit("ko").alias("language"), F.lit(KO_CONTINUE_CODE).alias("p")))
    return d.withColumn("_q", F.explode(prompts)).select(*keys, "_q.language", F.concat(F.col("_q.p"), F.lit("\n\n"), "_l").alias("input"), F.col("_r").alias("output"))


def code_snippet(c, max_lines: int = 28, max_chars: int = 1200) -> Column:
    """First fenced block (else the whole text): non-empty lines, bounded lines and characters."""
    s = X.strip(c)
    block = F.regexp_extract(s, r"```[a-zA-Z0-9_+-]*\n([\s\S]{8,1800}?)```", 1)
    src = F.when(block == "", s).otherwise(X.strip(block))
    kept = F.filter(F.transform(F.split(src, LINE_ENDS), lambda x: F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+\z", "")), lambda x: X.strip(x) != "")
    out = X.strip(F.array_join(F.slice(kept, 1, max_lines), "\n"))
    return F.regexp_replace(F.substring(out, 1, max_chars), r"(?U)[\s\x1c-\x1f]+\z", "")


def snippet_rows(df: DataFrame, key: str, c: str, size: str | None = None) -> DataFrame:
    """Language row (when known) and description row per code snippet; ``size`` names a column for the snippet's length."""
    # One-element explodes: a snippet and what is found in it are worked out once a row, not again wherever they are named.
    d = df.select(key, F.explode(F.array(code_snippet(c))).alias("_s")).filter("_s <> ''")
    d = d.select("*", F.explode(F.array(F.struct(C.language_of_code("_s").alias("g"), C.code_action("_s").alias("a")))).alias("_f"))
    d = d.select(key, "_s", F.col("_f.g").alias("_g"), F.col("_f.a").alias("_a"), *([F.length("_s").cast("long").alias(size)] if size else []))
    body = F.concat(F.lit("Snippet:\n```text\n"), F.col("_s"), F.lit("\n```"))
    ask1 = "Identify the most likely programming language of the snippet and explain your reasoning in two short points.\n\n"
    ask2 = "Give a concise English description of what this code is mainly doing. Also mention one potential risk or edge case.\n\n"
    out1 = F.concat(F.lit("The most likely language is "), F.col("_g.lang"), F.lit(". Evidence: 1) "), F.col("_g.cue1"), F.lit(". 2) "), F.col("_g.cue2"), F.lit("."))
    out2 = F.concat(F.lit("This code mainly handles "), F.col("_a"), F.lit(". One potential risk is that "), C.action_risk(F.col("_a")), F.lit("."))
    rows = F.array(
        F.when(F.col("_g.lang") != "Unknown", F.struct(F.lit("lang").alias("kind"), F.concat(F.lit(ask1), body).alias("input"), out1.alias("output"))),
        F.struct(F.lit("desc").alias("kind"), F.concat(F.lit(ask2), body).alias("input"), out2.alias("output")),
    )
    return _fan_out(d, [F.get(rows, F.lit(0)), F.get(rows, F.lit(1))], [key, *([size] if size else [])])


# ------------------------------------------------------------------ multiple choice and yes/no


def option_map(c) -> Column:
    """'A) text' lines -> map of letter to text."""
    opt = F.filter(lines(c), lambda x: x.rlike(r"\A[ABCD]\)\s*\S"))
    # A letter given twice keeps its last text, as a dictionary would.
    letters = F.transform(opt, lambda x: F.substring(x, 1, 1))
    last = F.filter(opt, lambda x, i: F.array_position(F.slice(letters, i + 2, F.size(letters)), F.substring(x, 1, 1)) == 0)
    return F.map_from_entries(F.transform(last, lambda x: F.struct(F.substring(x, 1, 1).alias("k"), X.clean_text(F.substr(x, F.lit(3))).alias("v"))))


def answer_letter(c) -> Column:
    return F.regexp_extract(F.upper(X.text(c)), r"(?U)\b([ABCD])\b", 1)


def mcq_content(inp, out) -> Column:
    """Letter answer -> '[subject] letter) option text'; null where it cannot be parsed."""
    a = answer_letter(out)
    subject = X.clean_text(F.regexp_extract(X.text(inp), r"(?i)\AQuestion\s*\((.*?)\)\s*:", 1))
    chosen = F.try_element_at(option_map(inp), a)
    text = F.concat(a, F.lit(") "), chosen)
    return F.when(a != "", F.when(subject != "", F.concat(F.lit("["), subject, F.lit("] "), text)).otherwise(text))


def mcq_rows(df: DataFrame, keys: Sequence[str], question: Column, options: Sequence[tuple[str, Column]], letter: Column, subject: Column | None = None) -> DataFrame:
    """Letter, text and letter+text rows per question; incomplete questions dropped."""
    q = X.normalize_space(F.substring(X.normalize_space(question), 1, 420))
    opts = [(k, F.rtrim(F.substring(X.normalize_space(v), 1, 180))) for k, v in options]
    d = df.select(*keys, q.alias("_q"), *[v.alias(f"_opt{k}") for k, v in opts], F.upper(X.normalize_space(letter)).alias("_l"),
                  (X.normalize_space(subject) if subject is not None else F.lit("")).alias("_s"))
    answer = F.lit("")
    full = F.lit(True)
    for k, _ in opts:
        answer = F.when(F.col("_l") == k, F.col(f"_opt{k}")).otherwise(answer)
        full = full & (F.col(f"_opt{k}") != "")
    block = F.concat_ws("\n", *[F.concat(F.lit(f"{k}. "), F.col(f"_opt{k}")) for k, _ in opts])
    field = F.when(F.col("_s") != "", F.concat(F.lit(" 분야: "), F.col("_s"), F.lit("."))).otherwise("")

    def ask(text):
        return X.normalize_space(F.concat(F.lit(text), field, F.lit("\n문제: "), F.col("_q"), F.lit("\n"), block))

    d = d.withColumn("_ans", answer).filter(full & (F.col("_q") != "") & (F.col("_ans") != ""))
    rows = F.array(
        F.struct(F.lit("letter").alias("kind"), ask("다음 객관식 문제를 풀고 선택지 문자만 답하라.").alias("input"), F.col("_l").alias("output")),
        F.struct(F.lit("text").alias("kind"), ask("다음 객관식 문제를 풀고 정답 내용을 짧게 답하라.").alias("input"), F.col("_ans").alias("output")),
        F.struct(F.lit("both").alias("kind"), ask("다음 객관식 문제를 풀어 한 줄로 답하라.").alias("input"), F.concat_ws(". ", "_l", "_ans").alias("output")),
    )
    return d.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


# Prompts and answers of the two yes/no sources.
BOOLEAN_TEXTS = {
    "boolq": ("다음 문단을 읽고 질문에 예 또는 아니오만 답하라.", "다음 문단을 읽고 질문에 한 문장으로 답하라.", "문단: ", "질문: ",
              "예. 문단의 내용과 일치합니다.", "아니오. 문단의 내용과 일치하지 않습니다."),
    "paraphrase": ("다음 두 문장이 같은 의미인지 판단하라. 예 또는 아니오만 답하라.", "다음 두 문장의 의미 관계를 한 문장으로 답하라.", "문장1: ", "문장2: ",
                   "예. 두 문장은 같은 의미입니다.", "아니오. 두 문장의 의미가 다릅니다."),
}


def boolean_rows(df: DataFrame, keys: Sequence[str], first: Column, second: Column, label: Column, kind: str = "boolq", first_chars: int = 700, second_chars: int = 10**9) -> DataFrame:
    """Short and explained rows of (text, text, 0/1)."""
    ask_short, ask_long, p1, p2, yes, no = BOOLEAN_TEXTS[kind]
    a = F.rtrim(F.substring(X.normalize_space(first), 1, first_chars))
    b = F.rtrim(F.substring(X.normalize_space(second), 1, second_chars))
    d = df.select(*keys, a.alias("_a"), b.alias("_b"), label.cast("int").alias("_y")).filter("_a <> '' AND _b <> '' AND _y IN (0, 1)")

    def ask(text):
        return F.concat(F.lit(text + " " + p1), F.col("_a"), F.lit(" " + p2), F.col("_b"))

    rows = F.array(
        F.struct(F.lit("short").alias("kind"), ask(ask_short).alias("input"), F.when(F.col("_y") == 1, "예").otherwise("아니오").alias("output")),
        F.struct(F.lit("explained").alias("kind"), ask(ask_long).alias("input"), F.when(F.col("_y") == 1, yes).otherwise(no).alias("output")),
    )
    return d.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


# ------------------------------------------------------------------ tool rows

# The tool prompt.
TOOL_HEAD = "도구: - search(term): 개념, 서비스, 제품, 인물, 장소 정보를 찾는다. - calculator(expr): 수식 계산을 한다. 질문: "
TOOL_ASK = " 출력 형식: - ACTION search <검색어> - ACTION calculator <식> - FINAL <답> 한 줄만 출력하라."
TOOL_FINAL = " 출력 형식: FINAL <답> 한 줄만 출력하라."


def tool_prompt(question: Column, observation: Column | None = None) -> Column:
    q = F.concat(F.lit(TOOL_HEAD), X.normalize_space(question))
    if observation is None:
        return F.concat(q, F.lit(TOOL_ASK))
    return F.concat(q, F.lit(" "), X.normalize_space(observation), F.lit(TOOL_FINAL))


def tool_rows(df: DataFrame, key: str, inp: str, out: str, caps: dict[str, int] | None = None, script: Script = HANGUL) -> DataFrame:
    """Definition pair -> ACTION and FINAL rows; expression -> calculator rows; others -> FINAL row.

    ``caps`` limits the source rows of each kind in key order.
    """
    from pairmill.operators.sample import position_ranked

    d = df.select(key, X.normalize_space(inp).alias("_q"), X.normalize_space(out).alias("_a"))
    expr, value = binary_expression("_q")
    d = d.select(key, "_q", "_a", Q.definition_term("_q", script).alias("_t"), expr.alias("_e"), value.alias("_v"))
    asks = F.col("_q").rlike(R.ux(KOREAN.definition)) & (F.length("_t") >= 2)
    near = F.contains(F.lower("_a"), F.col("_t")) | (X.best_term_similarity("_t", "_a", script) >= 0.86)
    d = d.withColumn("kind", F.when(asks & near, "definition").when(F.col("_v").isNotNull(), "calculator").otherwise("direct"))
    if caps:
        cap = F.lit(0)
        for k, n in caps.items():
            cap = F.when(F.col("kind") == k, n).otherwise(cap)
        d = position_ranked(d, key, ["kind"], "_r", limit=cap).drop("_r")
    act = F.when(F.col("kind") == "definition", F.concat(F.lit("ACTION search "), F.col("_t"))).otherwise(F.concat(F.lit("ACTION calculator "), F.col("_e")))
    seen = F.when(F.col("kind") == "definition", X.first_sentence("_a", 220)).otherwise(number_text(F.col("_v")))
    final = F.when(F.col("kind") == "calculator", F.concat(F.lit("FINAL "), number_text(F.col("_v")), F.lit("입니다."))).otherwise(F.concat(F.lit("FINAL "), F.col("_a")))
    tool = F.col("kind") != "direct"
    steps = F.array(
        F.when(tool, F.struct(F.lit("action").alias("step"), tool_prompt(F.col("_q")).alias("input"), act.alias("output"))),
        F.struct(F.lit("final").alias("step"), F.when(tool, tool_prompt(F.col("_q"), F.concat(act, F.lit(" OBSERVATION "), seen))).otherwise(tool_prompt(F.col("_q"))).alias("input"), final.alias("output")),
    )
    return _fan_out(d, [F.get(steps, F.lit(0)), F.get(steps, F.lit(1))], [key, "kind"])


def number_text(v: Column) -> Column:
    """Whole numbers without a point, others with up to six decimals and no trailing zeros."""
    near = F.abs(v - F.round(v)) < 1e-9
    return F.when(near, F.round(v).cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", v), r"\.?0+\z", ""))


def binary_expression(c) -> tuple[Column, Column]:
    """(expression text, value) of the first 'a op b'; null value for none or a division by zero."""
    m = F.regexp_substr(X.normalize_space(c), F.lit(r"\d+(?:\.\d+)?\s*[+\-*/]\s*\d+(?:\.\d+)?"))
    a = F.regexp_extract(m, r"\A([\d.]+)", 1).cast("double")
    b = F.regexp_extract(m, r"([\d.]+)\z", 1).cast("double")
    op = F.regexp_extract(m, r"\A[\d.]+\s*([+\-*/])", 1)
    v = F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when((op == "/") & (b != 0), a / F.nullif(b, F.lit(0.0)))
    return m, v


def ratio_question(c) -> Column:
    """struct(expr, value, unit, asked) of 'X과 Y 비율 a:b, Y가 n이면 X는?'; null otherwise."""
    q = X.normalize_space(c)
    num, name = r"([0-9]+(?:\.[0-9]+)?)", "([A-Za-z가-힣]+)"
    head = rf"{name}\s*과\s*{name}\s*(?:의\s*)?비율(?:이|은|는)?\s*{num}\s*:\s*{num}"
    given = rf"{name}\s*가\s*{num}\s*([A-Za-z가-힣%]*)\s*이면"
    asked = F.regexp_extract(q, rf"(?:이면|일때|일 때)\s*{name}\s*(?:은|는)\s*\??\s*\z", 1)
    a, b = F.regexp_extract(q, head, 1), F.regexp_extract(q, head, 2)
    ra, rb = F.regexp_extract(q, head, 3).try_cast("double"), F.regexp_extract(q, head, 4).try_cast("double")
    who, n, unit = F.regexp_extract(q, given, 1), F.regexp_extract(q, given, 2).try_cast("double"), F.regexp_extract(q, given, 3)
    known = F.when(who == a, ra).when(who == b, rb)
    want = F.when(asked == a, ra).when(asked == b, rb)
    v = n * want / F.nullif(known, F.lit(0.0))
    expr = F.concat(number_text(n), F.lit("*"), number_text(want), F.lit("/"), number_text(known))
    return F.when(v.isNotNull() & (a != ""), F.struct(expr.alias("expr"), v.alias("value"), unit.alias("unit"), asked.alias("asked")))


# ------------------------------------------------------------------ rewrites


def anchored_answer(term, answer, max_chars: int = 180) -> Column:
    """First sentence, prefixed with term and topic particle when the term is absent."""
    a = X.first_sentence(answer, max_chars)
    t = X.text(term)
    return F.when((t == "") | F.contains(F.lower(a), F.lower(t)), a).otherwise(X.normalize_space(F.concat(X.with_particle(t, "은", "는"), F.lit(" "), a)))


# Categories and suffix of the answer-only warm-up; hint lines of the tutor form.
ANSWER_ONLY = ("arithmetic_addsub", "arithmetic_muldiv", "ratio", "compare_smallest")
ANSWER_ONLY_SUFFIX = "\n추가 규칙:\n- 설명 금지\n- 다른 문장 금지\n- 한 줄만 출력\n- 형식은 정확히 `정답: 값`\n- 예시: 정답: 42"
DEFAULT_REASON = "조건을 차례대로 비교하면 답을 정할 수 있습니다."


def answer_only(df: DataFrame, inp: str = "input", answer: str = "final_answer", category: str = "category") -> DataFrame:
    """Kept categories -> first prompt line with the fixed suffix and the bare answer."""
    first = F.coalesce(F.get(F.filter(lines(inp), lambda x: x != ""), F.lit(0)), F.lit(""))
    head = X.strip(F.substring_index(first, "답변 형식", 1))
    d = df.filter(F.col(category).isin(*ANSWER_ONLY)).withColumn("_h", head).filter((F.col("_h") != "") & (X.strip(answer) != ""))
    return d.withColumns({inp: F.concat("_h", F.lit(ANSWER_ONLY_SUFFIX)), "output": F.concat(F.lit("정답: "), X.strip(answer)), "answer_format": F.lit("정답: ...")}).drop("_h")


def tutor_output(output, answer) -> Column:
    """Reason line -> hint, retry, answer and summary lines."""
    reason = X.strip(F.regexp_extract(X.text(output), r"(?m)^[ \t]*이유:(.*)$", 1))
    why = F.when(reason == "", F.lit(DEFAULT_REASON)).otherwise(reason)
    a = X.strip(answer)
    return F.concat(F.lit("힌트: 핵심 조건을 한 줄씩 정리하라.\n재시도: "), why, F.lit("\n정답: "), a, F.lit("\n요약: 핵심 조건을 따라가면 답은 "), a, F.lit("입니다."))


# Texts appended by the prompt mutators.
MUTATORS = (
    ("boundary", "\n\nExtra constraint: include boundary values 0, 1, -1 and one very large number case."),
    ("constraint_clash", "\n\nExtra constraint: be concise, but include one explicit exception case."),
    ("ambiguity", "\n\nIf any ambiguity exists, state assumptions first."),
    ("length_cap", "\n\nConstraint: answer within 6 sentences."),
)


def mutate_prompts(df: DataFrame, key: str, prompt: str, seed, share: float = 0.18) -> DataFrame:
    """Identity, appended constraints, reversed sentences and random line breaks; distinct (mutator, text)."""
    s = X.strip(prompt)
    parts = X.sentences(prompt)
    reorder = F.when(F.size(parts) >= 2, F.array_join(F.reverse(parts), " ")).otherwise(s)
    words = F.filter(F.split(X.normalize_space(s), " "), lambda x: x != "")
    broken = F.array_join(
        F.transform(words, lambda w, i: F.concat(w, F.when((i < F.size(words) - 1) & (uniform(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string")))) < share), "\n").otherwise(" "))), "")
    spaced = F.when(F.size(words) <= 3, s).otherwise(F.rtrim(broken))
    arms = [("identity", s), ("reorder", reorder), ("whitespace", spaced), *[(n, F.concat(s, F.lit(t))) for n, t in MUTATORS]]
    rows = F.array(*[F.struct(F.lit(n).alias("mutator"), v.alias("text")) for n, v in arms])
    return df.select(key, F.explode(F.array_distinct(rows)).alias("m")).select(key, "m.*")


# Likelihood bounds by hardness.
NLL_BOUND = {"hard": 2.6, "soft": 3.1, "observational": 3.8}


def spec_rows(df: DataFrame, key: str, inp: str, out: str, tier: str, n: int, seed, min_chars: int = 8, script: Script = HANGUL) -> DataFrame:
    """Pairs of enough characters -> (id, tier, prompt, target, verifier, meta), a seeded sample of ``n``."""
    from pairmill.operators.sample import take

    q, a = X.normalize_space(inp), X.normalize_space(out)
    both = R.merged(q, a)
    sc, latin = X.script_count(both, script), X.count_in(both, "A-Za-z")
    lang = F.when((sc >= 4) & (sc >= F.floor(0.2 * F.greatest(latin, F.lit(1)))), script.hints[0]).when(latin > 0, "en").otherwise("other")
    h = X.tier_hardness(tier)
    bound = F.when(h == "hard", NLL_BOUND["hard"]).when(h == "soft", NLL_BOUND["soft"]).otherwise(NLL_BOUND["observational"])
    d = df.filter((F.length(q) >= min_chars) & (F.length(a) >= min_chars))
    d = take(d, n, seed, key)
    return d.select(
        key, F.concat(F.lit("spec_"), F.lpad(F.col(key).cast("string"), 7, "0")).alias("id"), h.alias("tier"), q.alias("prompt"), a.alias("target"),
        F.struct(F.lit("nll").alias("type"), bound.alias("max_token_nll")).alias("verifier"), F.create_map(F.lit("language"), lang).alias("meta"))


def distill_rows(rules: DataFrame, n: int) -> DataFrame:
    """Top rules by (uses, created_step) as instruction rows; ``n`` is a report-sized top-k."""
    top = rules.orderBy(F.col("uses").desc(), F.col("created_step").desc()).limit(n)
    inp = F.concat(F.lit("Apply verified rules when relevant and answer the user query.\n\nVerified rule:\n"), "rule_text", F.lit("\n\nUser query:\n"), "prompt")
    return top.select("patch_id", inp.alias("input"), F.col("target").alias("output"), "uses", F.lit("high").alias("_meta_quality_tier"))


# Phrases around prompts and answers (an empty entry given twice counts double).
ASK_BEFORE = ("", "", "간단히 ", "짧게 ", "한국어로 ", "핵심만 ", "한 줄로 ")
ASK_AFTER = ("", "", " 설명해줘", " 알려줘", " 답해줘", " 부탁해", " 요약해줘")
SAY_BEFORE = ("", "", "요약하면 ", "한 줄로 말하면 ", "핵심은 ", "간단히 말해 ")


def pick(words: Sequence[str], key: Column) -> Column:
    i = F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % len(words)
    return F.element_at(F.array(*[F.lit(w) for w in words]), (i + 1).cast("int"))


def phrase_variants(df: DataFrame, key: str, inp: str, out: str, n: int, seed) -> DataFrame:
    """``n`` draws of prefix x prompt x suffix and answer prefix per pair, then first of equal pairs.

    Draws fan out inside the row, so no phrase table is joined; duplicates can only arise
    where prompts repeat and are removed by pair key.
    """
    from pairmill.operators.dedup import first_wins, pair_key

    d = df.select(key, inp, out).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def h(tag):
        return order_key(seed, F.lit(tag), key, "draw")

    q = X.normalize_space(F.concat(pick(ASK_BEFORE, h("a")), F.col(inp), pick(ASK_AFTER, h("b"))))
    a = X.normalize_space(F.concat(pick(SAY_BEFORE, h("c")), F.col(out)))
    d = d.select(key, "draw", q.alias("input"), a.alias("output")).withColumn("_k", pair_key("input", "output"))
    return first_wins(d, ["_k"], [key, "draw"]).drop("_k")


def term_templates(df: DataFrame, term: str, definition: str) -> DataFrame:
    """term x definition x question template with the right particles."""
    t = F.col(term)
    qs = F.array(
        X.with_particle(t, "이란", "란"), F.concat(X.with_particle(t, "이", "가"), F.lit(" 뭐야?")), F.concat(t, F.lit(" 정의")), F.concat(t, F.lit(" 설명해줘")),
        F.concat(F.lit("한국어로 "), X.with_particle(t, "이란", "란")), F.concat(X.with_particle(t, "을", "를"), F.lit(" 한 줄로 설명해줘")),
        F.concat(X.with_particle(t, "이", "가"), F.lit(" 무엇인지 알려줘")),
    )
    return df.select(term, F.explode(qs).alias("input"), X.normalize_space(definition).alias("output"))


def suite_rows(suite: DataFrame, canonical: DataFrame, item: str, repeats: int, replay: DataFrame, n_replay: int, seed, key: str) -> DataFrame:
    """Canonical suite answers repeated, plus replay rows."""
    from pairmill.operators.joins import canonical_join
    from pairmill.operators.sample import repeat_pool, take

    base = canonical_join(suite, canonical, item).select(F.col("prompt").alias("input"), F.col("answer").alias("output"), F.lit("suite").alias("part"))
    rest = take(replay, n_replay, seed, key).select("input", "output", F.lit("replay").alias("part"))
    return repeat_pool(base, repeats).unionByName(rest)


def leaked_prompts(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Training rows whose normalized prompt is also an evaluation prompt."""
    k = F.lower(X.normalize_space("input"))
    return train.withColumn("_k", k).join(evaluation.select(k.alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def tokenizer_lines(df: DataFrame, key: str, inp: str, out: str, max_chars: int = 1600) -> DataFrame:
    """Input line, output line and joined line per row; blanks collapsed, short lines dropped, long lines cut."""
    q, a = X.normalize_space(inp), X.normalize_space(out)
    joined = F.when((q != "") & (a != ""), F.concat(F.lit("### Instruction "), q, F.lit(" ### Response "), a))
    d = df.select(key, F.posexplode(F.array(q, a, joined)).alias("part", "line")).filter(F.length("line") >= 2)
    return d.withColumn("line", F.rtrim(F.substring("line", 1, max_chars)))


# Fixed values: "all A are B" in Korean and English.
ALL_FACT_KO = "모든\\s+([A-Za-z가-힣]+)(?:은|는|이|가)\\s*([A-Za-z가-힣]+?)(?:이다|다)(?:\\s|\\z|[.?!,])"
ALL_FACT_EN = "(?i)all\\s+([A-Za-z]+)\\s+are\\s+([A-Za-z]+)(?:\\s|\\z|[.?!,])"


def subset_facts(df: DataFrame, prompt: str, c: str) -> DataFrame:
    """(prompt, a, b) edges of the universal statements in a text."""
    def found(p):
        pat = F.lit(p)
        return F.arrays_zip(F.regexp_extract_all(X.text(c), pat, F.lit(1)).alias("a"), F.regexp_extract_all(X.text(c), pat, F.lit(2)).alias("b"))

    d = df.select(prompt, F.explode(F.array_union(found(ALL_FACT_KO), found(ALL_FACT_EN))).alias("f"))
    return d.select(prompt, "f.a", "f.b").filter("a <> b").distinct()


def subset_closure(edges: DataFrame, prompt: str) -> DataFrame:
    """Reflexive-transitive closure per prompt. Only the pairs of the last round are joined with all pairs
    so far, and path lengths double each round: rounds grow with the logarithm of the longest chain and end
    when nothing is new; lineage is cut every round."""
    from pairmill.session import cut_lineage

    nodes = edges.select(prompt, F.col("a")).unionByName(edges.select(prompt, F.col("b").alias("a"))).distinct()
    reach = cut_lineage(edges.select(prompt, "a", "b").unionByName(nodes.select(prompt, "a", F.col("a").alias("b"))).distinct())
    new = reach.filter("a <> b")
    while not new.isEmpty():
        step = new.select(prompt, "a", F.col("b").alias("m")).join(reach.select(prompt, F.col("a").alias("m"), "b"), [prompt, "m"])
        new = cut_lineage(step.select(prompt, "a", "b").distinct().join(reach, [prompt, "a", "b"], "left_anti"))
        reach = cut_lineage(reach.unionByName(new))
    return reach
