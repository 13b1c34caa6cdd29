"""Whole reject cascades, and the rules, scans and shuffles that the other modules only use in part."""

from pyspark.sql import functions as F

from pairmill.catalog.base import CHAT, LET, QA, SYM, case, cnt, div, kterms, norm, toks, words_in
from pairmill.catalog.filtering import D, KO, ci, outside, rx
from pairmill.catalog.shaping import runs
from pairmill.functions import classify as C
from pairmill.functions import filters as R
from pairmill.functions import text as X
from pairmill.functions.lexicon import KOREAN, WESTERN
from pairmill.operators import aggregate as A
from pairmill.operators import generate as N
from pairmill.schema import LATIN
from pairmill.sources import jsonl as J
from pairmill.sources import sinks as K

W = WESTERN


def top(words: str) -> str:
    return f"coalesce(list_max(list_transform(list_distinct({words}), lambda x: len(list_filter({words}, lambda y: y = x)))), 0)"


TOKENS = "regexp_extract_all(lower(o), '[0-9A-Za-z가-힣]+')"


@case("f28_general_output", rf"""WITH {QA}, n AS (SELECT p_partkey, {norm("output || CASE WHEN p_partkey % 7 = 0 THEN ' 다시 다시 다시 다시 다시 말하면 그렇다' WHEN p_partkey % 11 = 0 THEN ' привет' ELSE '' END")} AS o FROM qa),
 w AS (SELECT *, {TOKENS} AS w FROM n), b AS (SELECT *, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) AS g FROM w)
 SELECT p_partkey, {outside('o', 8, 240)} OR {cnt('o', KO)} = 0 OR regexp_matches(o, '[Ѐ-ӿ]') OR {div(cnt('o', r'\p{Nd}'), 'length(o)', '1.0')} > 0.22
  OR (len(w) >= 8 AND (({top('w')} >= 4 AND {top('w')}::DOUBLE / len(w) >= 0.24) OR {top('g')} >= 3))
  OR {words_in('o', KOREAN.arithmetic_markers + KOREAN.style_markers)} OR {words_in('o', KOREAN.code_markers, True)} AS bad FROM b""")
def _(t):
    more = F.when(F.col("p_partkey") % 7 == 0, " 다시 다시 다시 다시 다시 말하면 그렇다").when(F.col("p_partkey") % 11 == 0, " привет").otherwise("")
    return t.qa.select("p_partkey", R.general_output(F.concat("output", more)).alias("bad"))


I, O = "i", "o"
WEAK = f"({cnt('b', SYM)} < 6 OR {div(cnt('b', SYM), cnt('b', LET))} < 0.30)"
MISS = f"""(len(kq) > 0 AND len(list_intersect(kq, ka)) = 0 AND NOT ({rx(I, W.logic)} OR {rx(I, W.math)} OR {rx(I, W.syllogism)}) AND ({rx(I, W.definition)} OR len(kq) <= 4))"""


@case("f29_quality_reason", rf"""WITH {CHAT}, n AS (SELECT conv_id, turn, conv_id * 100000 + turn AS rid, {norm('input')} AS i, {norm('output')} AS o FROM chat),
 m AS (SELECT *, i || chr(10) || o AS b, {kterms(I, W.fillers)} AS kq, {kterms(O, W.fillers)} AS ka, {toks(O)} AS w FROM n), r AS ({runs('b', 8, 'm', 'rid')})
 SELECT conv_id, turn, CASE WHEN i = '' OR o = '' THEN 'missing_pair' WHEN {outside(I, 2, 900)} THEN 'input_length' WHEN {outside(O, 12, 1100)} THEN 'output_length'
  WHEN contains(b, chr(65533)) OR contains(b, '???') THEN 'encoding_noise' WHEN {rx('b', ci(W.leak_ci))} THEN 'template_leak' WHEN coalesce(hit, false) THEN 'char_repeat' WHEN {rx('b', ci(W.code_ci))} THEN 'code_like'
  WHEN {rx(I, ci(W.intro_query_ci))} THEN 'intro_query' WHEN {rx(O, ci(W.intro_answer_ci))} THEN 'intro_answer' WHEN {rx(O, ci(W.meta_style_ci))} THEN 'meta_style' WHEN {WEAK} THEN 'ko_weak' WHEN {MISS} THEN 'keyword_miss'
  WHEN {rx(I, W.math)} AND NOT regexp_matches(o, '\d') THEN 'math_without_digits' WHEN {rx(I, W.syllogism)} AND NOT {rx(O, W.syllogism_words)} THEN 'syllogism_weak'
  WHEN len(w) >= 14 AND {div('len(list_distinct(w))', 'len(w)', '1.0')} < 0.32 THEN 'low_diversity' END AS reason FROM m LEFT JOIN r USING (rid)""")
def _(t):
    return t.chat.select("conv_id", "turn", R.first_reason(R.quality_rules("input", "output", LATIN, W)).alias("reason"))


def corrupt(c: str) -> str:
    q = f"(length({c}) - length(replace({c}, '?', '')))"
    syl, jam, han, wide = cnt(c, KO), cnt(c, "ㄱ-ㅣ"), cnt(c, "一-鿿"), cnt(c, r"^\x00-\x7f")
    mine = f"({syl} = 0 AND {wide} >= 10 AND {jam} + {han} >= 8) OR ({han} >= 6 AND {han} > greatest(2, {syl})) OR ({jam} >= 8 AND {jam} > greatest(4, {syl} // 2))"
    return f"({c} = '' OR contains({c}, chr(65533)) OR (contains({c}, '???') AND {q} >= greatest(8, length({c}) // 6)) OR ({q} >= 12 AND {q} >= length({c}) // 5) OR (language = 'ko' AND ({mine})))"


NOISED = "CASE p_partkey % 5 WHEN 0 THEN replace(output, '은 ', 'ㅋㅋㅋㅋ ') WHEN 1 THEN replace(output, ' ', '?') WHEN 2 THEN '' ELSE output END"


@case("f29_general_reason", f"""WITH {QA}, n AS (SELECT p_partkey, language, input AS i, {NOISED} AS o FROM qa)
 SELECT p_partkey, CASE WHEN i = '' OR o = '' THEN 'no_pair' WHEN {corrupt('i')} OR {corrupt('o')} THEN 'corrupt' END AS reason FROM n""")
def _(t):
    d = t.qa.withColumn("o", F.expr(NOISED))
    return d.select("p_partkey", R.first_reason(R.general_rules("input", "o", F.col("language"))).alias("reason"))


TERMS = [k for k, _ in KOREAN.required_terms]
TERM = f"CASE WHEN p_partkey % 3 = 0 THEN ' {TERMS[0]} ' ELSE {'[' + ', '.join(repr(k) for k in TERMS) + ']'}[p_partkey % {len(TERMS)} + 1] END"
SAID = "output || CASE WHEN p_partkey % 2 = 0 THEN ' 언어 플랫폼 메신저' WHEN p_partkey % 5 = 0 THEN ' jvm 구글' ELSE '' END"


@case("f19_required_terms", f"""WITH {QA}, n AS (SELECT p_partkey, {norm(TERM)} AS t, lower({norm(SAID)}) AS a FROM qa)
 SELECT p_partkey, CASE {' '.join(f"WHEN t = '{k}' THEN {words_in('a', [w.lower() for w in ws])}" for k, ws in KOREAN.required_terms)} ELSE true END AS met FROM n""")
def _(t):
    term = F.when(F.col("p_partkey") % 3 == 0, f" {TERMS[0]} ").otherwise(F.get(F.array(*[F.lit(k) for k in TERMS]), (F.col("p_partkey") % len(TERMS)).cast("int")))
    return t.qa.select("p_partkey", R.required_terms_met(term, F.expr(SAID)).alias("met"))


HELLO = "CASE p_partkey % 6 WHEN 0 THEN ' 안녕하세요! ' WHEN 1 THEN '저는 ' || term || ' AI 어시스턴트입니다.' WHEN 2 THEN '안녕하세요. ' || output WHEN 3 THEN '  ' ELSE output END"


@case("f12_intro_only_answer", f"WITH {QA}, n AS (SELECT p_partkey, {norm(HELLO)} AS a FROM qa) SELECT p_partkey FROM n WHERE a = '' OR {rx('a', ci(KOREAN.intro_only_ci))}")
def _(t):
    return t.qa.withColumn("a", F.expr(HELLO)).filter(R.intro_only_answer("a")).select("p_partkey")


@case("a08_file_fingerprint", """SELECT replace(p_brand, '#', '_') AS file, strlen(s)::BIGINT AS size_bytes, sha1(encode(s)[1:1048576]) AS head_sha1, true AS dated
 FROM (SELECT p_brand, string_agg(p_name, chr(10) ORDER BY p_partkey) || chr(10) AS s FROM part GROUP BY p_brand)""")
def _(t):
    path = K.shared_folder(t.spark, "files")
    rows = t.part.select(F.replace("p_brand", F.lit("#"), F.lit("_")).alias("file"), "p_partkey", F.col("p_name").alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "p_partkey").drop("p_partkey").write.partitionBy("file").text(path)
    f = A.file_fingerprint(t.spark.read.format("binaryFile").load(path))
    return f.select(F.regexp_extract("path", "file=([^/]+)/", 1).alias("file"), "size_bytes", "head_sha1", (F.col("mtime_us") > 1_500_000_000_000_000).alias("dated"))


@case("s03_glossary_rows", f"""SELECT {norm('p_name')} AS input, {norm('p_type')} AS output, p_partkey::BIGINT AS rank FROM part WHERE length({norm('p_name')}) >= 2 AND length({norm('p_type')}) >= 6 AND p_partkey <= 1500
 ORDER BY p_partkey LIMIT 400""")
def _(t):
    path = K.shared_folder(t.spark, "glossary")
    t.part.select(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name", F.lit("n"), F.col("p_type"), F.lit("A")).alias("value")).write.text(path)
    return J.glossary_rows(J.vocabulary_scan(t.spark, path, 1500, header=False), 400).select("input", "output", F.col("rank").cast("long").alias("rank"))


def _open_sql():
    from pairmill.catalog.tasks import SQLGEN, below

    k = N.sequence_open_parts()
    fixed = f"SELECT o_orderkey, '{k[0]}' AS input, '이유: {k[1]}' || chr(10) || '답: {k[2]}' AS output, '{k[2]}' AS final_answer FROM orders WHERE {below('open', 8)} = 0"
    return f"{fixed} UNION ALL SELECT s.* FROM ({SQLGEN['sequence']}) s JOIN orders o USING (o_orderkey) WHERE {below('open', 8)} <> 0"


@case("x28_gen_sequence_open", _open_sql())
def _(t):
    return N.sequences(t.orders.select("o_orderkey"), "o_orderkey", 42, one_in=8).select("o_orderkey", "input", "output", "final_answer")


ARMS = [
    "/a/x.manifest.json", "/data/by_field/x.jsonl", "/quality/hq_ko_chat_v1.jsonl", "/session_memory.jsonl", "/continual_buffer_2.jsonl", "/CCL_specbook.jsonl", "logic_reasoning_1.jsonl", "expert_reasoning.jsonl",
    "translation_v1.jsonl", "router_v2.jsonl", "identity.jsonl", "name_patch.jsonl", "stages_1.jsonl", "turbo_stage4.jsonl", "syllable_profile.json", "ko_clean.jsonl", "pure_ko_2.jsonl", "code_chat_ko.jsonl",
    "code_balanced.jsonl", "slm_mit_1.jsonl", "hf_mit.jsonl", "unified.jsonl", "capability_pack.jsonl", "kullm_v2.jsonl", "auto_gold.jsonl", "chat_mix.jsonl", "misc.jsonl", "other_two.jsonl",
]
#: (condition, field, confidence) in order; p is the path in lower case.
FIELDS = (
    ("suffix(p, '.manifest.json')", "profile_meta", 0.65), ("contains(p, '/by_field/')", "other", 0.5), ("contains(p, '/quality/') AND contains(p, 'hq_ko_chat')", "quality_curated", 0.95),
    ("regexp_matches(p, 'session_memory|continual_buffer')", "memory_continual", 0.95), ("contains(p, 'ccl_specbook')", "ccl_specbook", 0.98), ("regexp_matches(p, 'logic_reasoning|expert_reasoning')", "reasoning_logic", 0.95),
    ("contains(p, 'translation')", "translation_multilingual", 0.95), ("contains(p, 'router')", "routing_intent", 0.95), ("regexp_matches(p, 'identity|name_patch|name_disambig')", "identity_persona", 0.96),
    ("regexp_matches(p, 'stages_|turbo_stage4')", "stage_curriculum", 0.96), ("contains(p, 'profile')", "profile_meta", 0.9), ("regexp_matches(p, 'ko_clean|fluency|ratio_boost|pure_ko|ultra_targeted')", "ko_fluency_targeted", 0.92),
    ("contains(p, 'code') OR code >= 0.35", "coding_tech", 0.88), ("regexp_matches(p, 'mit_|slm_mit|hf_mit|lang_blend|domain_mix|unified')", "foundation_mit_mix", 0.9),
    ("contains(p, 'capability_pack') AND code >= 0.22", "coding_tech", 0.76), ("contains(p, 'capability_pack')", "reasoning_logic", 0.72), ("contains(p, 'kullm') AND code >= 0.25", "coding_tech", 0.72),
    ("contains(p, 'kullm')", "ko_chat_general", 0.72), ("regexp_matches(p, 'chat|auto_gold|intro_override') AND code >= 0.28", "coding_tech", 0.75), ("regexp_matches(p, 'chat|auto_gold|intro_override')", "ko_chat_general", 0.82),
    ("code >= 0.45", "coding_tech", 0.6), ("ko >= 0.6 AND chat >= 0.5", "ko_chat_general", 0.58),
)


@case("c04_field_classify_all", f"""WITH f AS (SELECT p_partkey, [{', '.join(f"'{a}'" for a in ARMS)}][p_partkey % {len(ARMS)} + 1] AS path, (p_size % 12) / 25.0::DOUBLE AS code, (p_partkey % 10) / 10.0::DOUBLE AS chat, (p_partkey % 7) / 6.0::DOUBLE AS ko FROM part),
 l AS (SELECT *, lower(path) AS p FROM f)
 SELECT p_partkey, CASE {' '.join(f"WHEN {c} THEN '{f}'" for c, f, _ in FIELDS)} ELSE 'other' END AS field, CASE {' '.join(f'WHEN {c} THEN {x}' for c, _, x in FIELDS)} ELSE 0.5 END::DOUBLE AS confidence FROM l""")
def _(t):
    k = F.col("p_partkey")
    path = F.get(F.array(*[F.lit(a) for a in ARMS]), (k % len(ARMS)).cast("int"))
    d = t.part.select(k, path.alias("path"), (F.col("p_size") % 12 / 25.0).alias("code"), (k % 10 / 10.0).alias("chat"), (k % 7 / 6.0).alias("ko"))
    c = C.classify_field("path", F.col("code"), F.col("chat"), F.col("ko"))
    return d.select("p_partkey", c.alias("c")).select("p_partkey", "c.field", F.col("c.confidence").cast("double").alias("confidence"))
