"""Registry of the checkable queries: one Spark callable and, where possible, one SQL text each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.functions import text as X
from pairmill.schema import LATIN

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


NL = "chr(10)"
W1, W2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"

# Written once in the SQL both engines read.
CODE_COLS = [
    "p_partkey",
    "p_brand AS repo",
    f"concat('src/', CASE p_size % 7 WHEN 0 THEN 'tests/' WHEN 1 THEN 'components/' WHEN 2 THEN 'cli/' WHEN 3 THEN 'config/' "
    f"WHEN 4 THEN 'docs/' ELSE 'core/' END, {W1}, '_', {W2}, CASE p_size % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.java' "
    "WHEN 3 THEN '.go' WHEN 4 THEN '.md' ELSE '.xyz' END) AS path",
    f"concat('import ', {W1}, {NL}, 'from ', {W2}, ' import ', {W1}, '_tool', {NL}, {NL}, 'def ', {W1}, '_', {W2}, '(x, y):', {NL}, "
    f"'    # part ', p_brand, {NL}, '    if x > ', CAST(p_size AS VARCHAR(9)), ':', {NL}, '        return ', {W1}, '_tool(x) + y', {NL}, "
    f"'    return y * ', CAST(p_size AS VARCHAR(9)), {NL}, "
    f"CASE WHEN p_size % 3 = 0 THEN concat('class ', {W2}, 'Box:', {NL}, '    import ', {W1}, {NL}) ELSE '' END, "
    f"CASE WHEN p_size % 5 = 0 THEN concat('function show(x) {{', {NL}, '  console.log(x);', {NL}, '}}', {NL}) ELSE '' END, "
    f"CASE WHEN p_size % 4 = 0 THEN concat('public int size(int n) {{', {NL}, '  return n;', {NL}, '}}', {NL}) ELSE '' END) AS code",
]
QA_COLS = [
    "p_partkey",
    f"CASE p_partkey % 8 WHEN 0 THEN concat({W1}, '이란?') WHEN 1 THEN concat({W2}, '란?') "
    "WHEN 2 THEN concat(CAST(p_size AS VARCHAR(9)), ' + ', CAST(p_partkey % 90 AS VARCHAR(9)), ' 계산해줘') "
    f"WHEN 3 THEN concat('모든 ', {W1}, ' 는 ', {W2}, '이다. 이유를 설명하라') WHEN 4 THEN concat('자기소개 해줘 ', {W1}) "
    f"WHEN 5 THEN concat('Explain ', {W1}, ' ', p_brand) WHEN 6 THEN concat({W1}, ' 간단히 설명해줘') ELSE concat({W1}, ' 점검 방법은?') END AS input",
    f"CASE p_partkey % 8 WHEN 0 THEN concat({W1}, '은 ', p_type, ' 종류의 부품입니다. 자세한 설명은 제조사 문서를 보세요.') "
    "WHEN 1 THEN '이 부품은 안전하게 보관해야 합니다.' "
    "WHEN 2 THEN concat('정답은 ', CAST(p_size + p_partkey % 90 AS VARCHAR(9)), '입니다.') "
    f"WHEN 3 THEN concat('결론: 참입니다. 따라서 ', {W1}, '는 ', {W2}, '입니다.') "
    f"WHEN 4 THEN concat('안녕하세요. 저는 ', {W1}, ' AI 어시스턴트입니다.') "
    f"WHEN 5 THEN concat('The ', {W1}, ' is a ', p_type, ' part used in many products and shops.') "
    f"WHEN 6 THEN concat('ㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋㅋ ', {W1}) "
    f"ELSE concat({W1}, ' 점검은 순서대로 진행합니다. ', {W2}, ' 상태를 먼저 확인하고 결과를 기록합니다.') END AS output",
    "CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'mid' WHEN 2 THEN '' END AS tier",
    "CASE p_size % 5 WHEN 0 THEN 'MIT' WHEN 1 THEN 'mit  license' WHEN 2 THEN 'GPL' WHEN 3 THEN 'Generated in-project' END AS license",
    "p_brand AS source_dataset",
    "CASE WHEN p_partkey % 3 = 0 THEN 'ko' ELSE '' END AS language",
    f"{W1} AS term",
]
CODE_COLS_SPARK = [c.replace("VARCHAR(9)", "STRING") for c in CODE_COLS]
QA_COLS_SPARK = [c.replace("VARCHAR(9)", "STRING") for c in QA_COLS]
CODE = f"code AS (SELECT {', '.join(CODE_COLS)} FROM part)"
QA = f"qa AS (SELECT {', '.join(QA_COLS)} FROM part)"


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores (one small file) is dealt out to all cores.

    Text work is per row and costs far more than moving a small table once. Tables of a real
    cluster have many splits and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df


class Tables:
    """The driver tables as attributes, plus the pair frames that Spark derives from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return spread(self.raw(name))

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def pairs(self) -> DataFrame:
        """documents as (input, output): first sentence and the rest, with tier and licence."""
        lab = self.labels.select("doc_id", "quality")
        t = F.col("text")
        return self.documents.join(lab, "doc_id", "left").select(
            "doc_id",
            "source",
            "lang",
            F.regexp_extract(t, r"^([^.!?\n]*)", 1).alias("input"),
            F.regexp_replace(t, r"^[^.!?\n]*[.!?\n]?", "").alias("output"),
            F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "mid").otherwise("").alias("tier"),
            F.when(t.contains("MIT License"), "MIT")
            .when(t.contains("General Public License"), "GPL")
            .when(t.contains("Apache"), " mit  license ")
            .alias("license"),
            F.when(F.col("lang") == "fr", "korean").when(F.col("lang") == "de", "code").otherwise(F.col("lang"))
            .alias("task_type"),
        )

    @property
    def code(self) -> DataFrame:
        """part rows written out as small source files."""
        return self.part.selectExpr(*CODE_COLS_SPARK)

    @property
    def qa(self) -> DataFrame:
        """part rows written out as Korean question and answer pairs of eight kinds."""
        return self.part.selectExpr(*QA_COLS_SPARK)

    @property
    def chat(self) -> DataFrame:
        """conversations as adjacent (user, assistant) pairs."""
        from pairmill.operators.dialog import dialog_pairs

        return dialog_pairs(self.conversations, "conv_id", "turn", "role", "text")


def case(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` together with its SQL text."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def r6(c):
    return F.round(c.cast("double"), 6)


# ---------------------------------------------------------------- SQL texts
# Helpers that spell out the same definitions in the SQL dialect of the checker.

SYM, LET, TOK = LATIN.symbols, LATIN.letters, LATIN.token
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def norm(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c},''), '{BLANK}+', ' ', 'g'))"


def strp(c: str) -> str:
    return f"regexp_replace(coalesce({c},''), '^{BLANK}+|{BLANK}+$', '', 'g')"


def cln(c: str) -> str:
    t = rf"regexp_replace(coalesce({c},''), '\r\n?', chr(10), 'g')"
    t = rf"regexp_replace({t}, '[ \t]+', ' ', 'g')"
    return strp(rf"regexp_replace({t}, '\n{{3,}}', chr(10)||chr(10), 'g')")


def cnt(c: str, cls: str) -> str:
    return f"len(regexp_extract_all(coalesce({c},''), '[{cls}]'))::BIGINT"


def div(a: str, b: str, empty: str = "0.0") -> str:
    return f"CASE WHEN ({b})=0 THEN {empty} ELSE ({a})::DOUBLE/({b}) END"


def rnd(e: str) -> str:
    return f"round(({e})::DOUBLE, 6)"


def toks(c: str, n: int = 2) -> str:
    q = "+" if n <= 1 else f"{{{n},}}"
    return f"regexp_extract_all(lower(coalesce({c},'')), '[{TOK}]{q}')"


def stem(x: str, particles=LATIN.particles) -> str:
    arms = " ".join(
        f"WHEN suffix({x}, '{p}') AND length({x}) > {len(p) + 1} THEN left({x}, length({x})-{len(p)})" for p in particles
    )
    return f"(CASE {arms} ELSE {x} END)"


def stoplist(extra=()) -> str:
    return "[" + ",".join(f"'{w}'" for w in sorted(set(LATIN.stopwords) | set(extra))) + "]"


def rtoks(c: str) -> str:
    return f"list_distinct(list_filter({toks(c)}, lambda x: NOT list_contains({stoplist()}, x)))"


def kterms(c: str, extra=()) -> str:
    s = f"list_transform({rtoks(c)}, lambda x: {stem('x')})"
    return f"list_distinct(list_filter({s}, lambda y: length(y) >= 2 AND NOT list_contains({stoplist(extra)}, y)))"


def jac(a: str, b: str) -> str:
    i = f"len(list_intersect({a},{b}))"
    return f"CASE WHEN len({a})+len({b})=0 THEN 1.0 ELSE {i}::DOUBLE/(len({a})+len({b})-{i}) END"


def words_in(c: str, words, low: bool = False) -> str:
    e = f"lower({c})" if low else c
    return "(" + " OR ".join(f"contains({e}, '{w}')" for w in words) + ")"


PAIRS = r"""pairs AS (
 SELECT d.doc_id, d.source, d.lang,
  regexp_extract(d.text, '^([^.!?\n]*)', 1) AS input,
  regexp_replace(d.text, '^[^.!?\n]*[.!?\n]?', '') AS output,
  CASE WHEN l.quality=1 THEN 'high' WHEN l.quality=0 THEN 'mid' ELSE '' END AS tier,
  CASE WHEN contains(d.text,'MIT License') THEN 'MIT' WHEN contains(d.text,'General Public License') THEN 'GPL'
       WHEN contains(d.text,'Apache') THEN ' mit  license ' END AS license,
  CASE WHEN d.lang='fr' THEN 'korean' WHEN d.lang='de' THEN 'code' ELSE d.lang END AS task_type
 FROM documents d LEFT JOIN labels l USING (doc_id))"""

CHAT = f"""chat AS (
 SELECT conv_id, turn, q AS input, t AS output FROM (
  SELECT conv_id, turn, r, t, lag(r) OVER w AS pr, lag(t) OVER w AS q FROM (
   SELECT conv_id, turn, lower({strp('role')}) AS r, {cln('text')} AS t FROM conversations) z
  WHERE t <> '' AND r IN ('user','assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 WHERE r='assistant' AND pr='user')"""
