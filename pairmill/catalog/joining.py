"""Joins (J), aggregations (A), windows (W) and scores (Q)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairmill.catalog.base import (BLANK, CHAT, LET, PAIRS, QA, SYM, TOK, case, cln, cnt, div, jac, kterms, norm, r6, rnd,
                                   rtoks, stem, strp, toks, words_in)
from pairmill.catalog.filtering import ALNUM, KO, KOL, ci, rx, solver
from pairmill.catalog.sampling import longest_first
from pairmill.functions import filters as R
from pairmill.functions import score as Q
from pairmill.functions import text as X
from pairmill.functions.lexicon import KOREAN, WESTERN
from pairmill.operators import aggregate as A
from pairmill.operators import dialog as W
from pairmill.operators import joins as J
from pairmill.schema import HANGUL, LATIN

D = "doc_id"
WST = WESTERN

ITEMS = list(Q.GENERAL_EXPECTATIONS) + list(Q.LOGIC_EXPECTATIONS)
ANS_COLS = [
    "o_orderkey",
    "concat('ck', CAST(o_custkey % 7 AS VARCHAR(9))) AS checkpoint",
    "CASE o_orderkey % 17 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(ITEMS)) + " END AS id",
    "CASE o_orderkey % 9 WHEN 0 THEN '코틀린은 JVM 언어입니다.' WHEN 1 THEN 'HTTP는 웹 요청과 응답 프로토콜입니다. 언어 토큰 jwt 인증' WHEN 2 THEN '모르겠습니다.' "
    "WHEN 3 THEN concat('정답: ', CAST(o_custkey AS VARCHAR(9))) WHEN 4 THEN '답: A' WHEN 5 THEN concat('안녕하세요. 도움을 드리고 질문을 정리합니다 ', o_orderpriority) "
    "WHEN 6 THEN '가 나 가 나 가 나 가 라 마' WHEN 7 THEN '99% 가용성 서비스 수준, 메모리 회수 3/5 확률' ELSE concat('보장할 수 없다 ', o_orderstatus, o_orderstatus, o_orderstatus) END AS stdout",
    "CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS returncode",
]
ANS = f"ans AS (SELECT {', '.join(ANS_COLS)} FROM orders)"


def answers(t):
    return t.orders.selectExpr(*[c.replace("VARCHAR(9)", "STRING") for c in ANS_COLS])


# ------------------------------------------------------------------ joins


@case("j01_index_to_files", """SELECT d.doc_id, d.source, CASE WHEN avg_len>2400 THEN 'long' ELSE 'short' END AS field FROM documents d JOIN (SELECT source, avg(n_chars) avg_len FROM documents WHERE source<>'src3' GROUP BY source) i USING (source)""")
def _(t):
    idx = t.documents.filter("source <> 'src3'").groupBy("source").agg(F.when(F.avg("n_chars") > 2400, "long").otherwise("short").alias("field"))
    return J.index_to_files(t.documents.select(D, "source"), idx, "source").select(D, "source", "field")


VOC = f"""voc AS (SELECT k AS term, CASE WHEN c>=200 THEN 'A' WHEN c>=60 THEN 'B' WHEN c>=30 THEN 'C' ELSE '' END AS grade FROM (SELECT k, count(*) c FROM (SELECT unnest({rtoks('text')}) AS k FROM documents) GROUP BY k HAVING count(*)>=20))"""


def vocab(t):
    c = t.documents.select(F.explode(X.retrieval_tokens("text", LATIN)).alias("term")).groupBy("term").agg(F.count("*").alias("c")).filter("c >= 20")
    return c.select("term", F.when(F.col("c") >= 200, "A").when(F.col("c") >= 60, "B").when(F.col("c") >= 30, "C").otherwise("").alias("grade"))


@case("j02_vocab_join", f"""WITH {CHAT}, {VOC}, x AS (SELECT conv_id, turn, unnest(list_distinct(list_concat({rtoks('input')}, {rtoks('output')}))) AS term FROM chat)
 SELECT c.conv_id, c.turn, coalesce(h.n,0)::BIGINT AS hits, {rnd('coalesce(h.s,0)')} AS score FROM chat c LEFT JOIN (SELECT conv_id, turn, count(*) n,
  sum(CASE grade WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.7 WHEN 'C' THEN 0.45 ELSE 0.5 END) s FROM x JOIN voc USING (term) GROUP BY ALL) h USING (conv_id, turn)""")
def _(t):
    chat = t.chat.withColumn("rid", F.concat_ws("|", "conv_id", "turn"))
    terms = F.array_union(X.retrieval_tokens("input", LATIN), X.retrieval_tokens("output", LATIN))
    d = J.vocab_hits(chat, "rid", terms, vocab(t))
    return d.select("conv_id", "turn", F.col("vocab_hits").cast("long").alias("hits"), r6(F.col("vocab_score")).alias("score"))


@case("j03_common_symbol_join", f"""WITH c AS (SELECT lang, unnest(regexp_extract_all(text,'[{SYM}]')) AS ch FROM documents), p AS (SELECT ch, count(*) n FROM c GROUP BY ch HAVING count(*)>=300)
 SELECT lang, count(*)::BIGINT AS symbols, count(p.ch)::BIGINT AS known FROM c LEFT JOIN p USING (ch) GROUP BY lang""")
def _(t):
    prof = J.common_symbols(A.symbol_profile(t.documents, "text", LATIN), 300)
    c = t.documents.select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"[{LATIN.symbols}]"), F.lit(0))).alias("ch")).groupBy("lang", "ch").agg(F.count("*").alias("n"))
    d = c.join(F.broadcast(prof.withColumn("k", F.lit(1))), "ch", "left")
    return d.groupBy("lang").agg(F.sum("n").alias("symbols"), F.sum(F.when(F.col("k") == 1, F.col("n")).otherwise(0)).alias("known"))


ASC = "[a-z]{7,}"


@case("j04_fuzzy_term_join", f"""WITH q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text),'{ASC}')) AS k FROM benchmark),
 c0 AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text),'{ASC}'))) AS term, text FROM documents),
 c AS (SELECT term, doc_id, length(text) AS size FROM c0),
 d AS (SELECT q.k, x.term, CASE WHEN q.k=x.term THEN 10.0 ELSE 1.0-levenshtein(q.k,x.term)::DOUBLE/greatest(length(q.k),length(x.term)) END AS sim
   FROM q JOIN (SELECT DISTINCT term FROM c) x ON abs(length(q.k)-length(x.term))<=2),
 s AS (SELECT k, c.term, c.doc_id, sim, least(0.35, 24.0/greatest(24,size)) AS b FROM (SELECT * FROM d WHERE sim>=0.84-1e-12) d JOIN c USING (term)),
 r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round((sim+b)::DOUBLE,9) DESC, doc_id, term DESC) rn FROM s WHERE sim>=0.84-1e-12)
 SELECT k, term AS matched, {rnd('sim+b')} AS score, md5(text) AS answer_md5 FROM r JOIN documents USING (doc_id) WHERE rn=1""")
def _(t):
    q = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(ASC), F.lit(0))).alias("k")).distinct()
    c = t.documents.select(D, F.length("text").alias("size"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(ASC), F.lit(0)))).alias("term"))
    best = J.fuzzy_term_join(q, c, "k", "term", "size", D)
    return best.join(t.documents.select(D, F.md5("text").alias("answer_md5")), D).select("k", "matched", r6(F.col("score")).alias("score"), "answer_md5")


@case("j05_used_key_anti", """SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 7 = 0)""")
def _(t):
    d = t.documents.select(D, F.md5("text").alias("k"))
    return J.unused(d, d.filter(F.col(D) % 7 == 0), "k").select(D)


@case("j06_topk_jaccard_join", f"""WITH q AS (SELECT conv_id, turn, list_distinct({toks('text')}) AS q FROM conversations WHERE role='user'),
 r AS (SELECT doc_id, list_transform(list_sort(list_transform(list_distinct({toks('text')}), lambda x: lpad((1000-length(x))::VARCHAR,4,'0')||x))[1:14], lambda y: substr(y,5)) AS k, least(0.08, 0.01*ln(1.0+doc_id%50)) AS b FROM documents WHERE doc_id%9<>0),
 qe AS (SELECT conv_id, turn, unnest(q) AS w FROM q), re AS (SELECT doc_id, unnest(k) AS w FROM r), o AS (SELECT conv_id, turn, doc_id, count(*) AS n FROM qe JOIN re USING (w) GROUP BY ALL),
 s AS (SELECT o.conv_id, o.turn, o.doc_id, round((n::DOUBLE/(len(q.q)+len(r.k)-n)+b)::DOUBLE, 9) AS sc FROM o JOIN q USING (conv_id, turn) JOIN r USING (doc_id)),
 t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY sc DESC, doc_id) rk FROM s) SELECT conv_id, turn, doc_id, rk::BIGINT AS rank, {rnd('sc')} AS score FROM t WHERE rk<=3""")
def _(t):
    q = t.conversations.filter("role = 'user'").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("qid"), "conv_id", "turn", X.words("text", LATIN).alias("q"))
    r = t.documents.select(D, longest_first("text", 14, LATIN).alias("kw"), (F.col(D) % 50).alias("uses"), F.when(F.col(D) % 9 == 0, "retired").otherwise("active").alias("status"))
    top = J.topk_jaccard(q, r, "qid", "q", D, "kw", "uses", D, 3, "status")
    return top.join(q.select("qid", "conv_id", "turn"), "qid").select("conv_id", "turn", D, F.col("rank").cast("long").alias("rank"), r6(F.col("score")).alias("score"))


VEC = "vec AS (SELECT vec_id, embedding, label, ['w'||(vec_id%11), 'x'||(vec_id%5), 'y'||(vec_id%3)] AS kw, (vec_id%13)/12.0 AS sc, vec_id%40 AS uses FROM embeddings WHERE vec_id%8<>0 AND vec_id%5 IN (0,1,2))"
PQ = "pq AS (SELECT p_partkey, list_distinct(['w'||(p_partkey%23), 'x'||(p_size%5), 'z'||p_size]) AS q FROM part)"
TOPV = f"""{VEC}, {PQ}, s AS (SELECT p_partkey, vec_id, round((0.60*{jac('q', 'kw')}+0.30*least(1.0,greatest(0.0,sc))+least(0.15,0.02*ln(1.0+uses)))::DOUBLE,9) AS sc FROM pq, vec),
 hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY sc DESC, vec_id) rk FROM s WHERE sc>0) WHERE rk<=3)"""


def vec_frames(t):
    v = t.embeddings.select("vec_id", "embedding", F.col("label").cast("long").alias("label"), F.array(*[F.concat(F.lit(p), (F.col("vec_id") % m).cast("string")) for p, m in (("w", 11), ("x", 5), ("y", 3))]).alias("kw"),
                            (F.col("vec_id") % 13 / 12.0).alias("sc"), (F.col("vec_id") % 40).alias("uses"),
                            F.when(F.col("vec_id") % 8 == 0, "merged").otherwise("active").alias("status"),
                            F.element_at(F.array(*[F.lit(x) for x in ("Skill", " fact ", "skill", "style", "tool")]), (F.col("vec_id") % 5 + 1).cast("int")).alias("kind"))
    q = t.part.select("p_partkey", F.array(F.concat(F.lit("w"), (F.col("p_partkey") % 23).cast("string")), F.concat(F.lit("x"), (F.col("p_size") % 5).cast("string")),
                                           F.concat(F.lit("z"), F.col("p_size").cast("string"))).alias("q"))
    return v, q


@case("j07_topk_vector_meta_join", f"WITH {TOPV} SELECT p_partkey, vec_id, rk::BIGINT AS rank, {rnd('sc')} AS score FROM hits")
def _(t):
    v, q = vec_frames(t)
    return J.topk_vectors(q, v, "p_partkey", "q", "vec_id", "kw", "sc", "uses", "vec_id", 3, "status", "kind", ("skill", "FACT")).select("p_partkey", "vec_id", F.col("rank").cast("long").alias("rank"), r6(F.col("score")).alias("score"))


@case("j07_compose_layers", f"""WITH {TOPV}, x AS (SELECT p_partkey, h.vec_id, h.sc, label%4 AS layer, embedding, unnest(range(0,64)) AS pos FROM hits h JOIN vec USING (vec_id)),
 v AS (SELECT p_partkey, layer, pos, sum(embedding[pos+1]::DOUBLE*sc*CASE WHEN vec_id%2=0 THEN 3.0 ELSE 2.0 END) AS val FROM x GROUP BY ALL),
 n AS (SELECT *, sqrt(sum(val*val) OVER (PARTITION BY p_partkey, layer)) AS nn FROM v) SELECT p_partkey, layer::BIGINT AS layer, pos::BIGINT AS pos, {rnd('CASE WHEN nn>2.0 THEN val*(2.0/nn) ELSE val END')} AS value FROM n WHERE pos<4""")
def _(t):
    v, q = vec_frames(t)
    top = J.topk_vectors(q, v, "p_partkey", "q", "vec_id", "kw", "sc", "uses", "vec_id", 3, "status", "kind", ("skill", "FACT"))
    v = v.withColumn("layer", F.col("label") % 4)
    c = J.compose_layers(top, v, "p_partkey", "vec_id", "layer", "embedding", F.when(F.col("vec_id") % 2 == 0, 3.0).otherwise(2.0))
    return c.filter("pos < 4").select("p_partkey", "layer", F.col("pos").cast("long").alias("pos"), r6(F.col("value")).alias("value"))


EXP = {**Q.GENERAL_EXPECTATIONS, **Q.LOGIC_EXPECTATIONS}


def match_sql(c="stdout"):
    low = f"lower({norm(c)})"
    arms = []
    for k, v in EXP.items():
        conds = []
        if v.get("max_len"):
            conds.append(f"length({low})<={v['max_len']}")
        conds += [f"contains({low}, '{w.lower()}')" for w in v.get("all", [])]
        if v.get("any"):
            conds.append("(" + " OR ".join(f"contains({low}, '{w.lower()}')" for w in v["any"]) + ")")
        arms.append(f"WHEN '{k}' THEN {' AND '.join(conds)}")
    return "CASE id " + " ".join(arms) + " ELSE true END"


@case("j08_expectation_join", f"WITH {ANS} SELECT o_orderkey, id, {match_sql()} AS matches FROM ans")
def _(t):
    return J.with_expectations(answers(t), J.expectation_frame(t.spark, EXP)).select("o_orderkey", "id", "matches")


@case("j09_canonical_join", """SELECT e.event_id, e.event_type AS id, c.canonical FROM events e JOIN (SELECT event_type, min(props) AS canonical FROM events WHERE event_type<>'error' GROUP BY event_type) c ON c.event_type=e.event_type""")
def _(t):
    e = t.events.select("event_id", F.col("event_type").alias("id"), "props")
    return J.canonical_join(e.drop("props"), e.filter("id <> 'error'").groupBy("id").agg(F.min("props").alias("canonical")))


@case("j10_term_summary_join", rf"""WITH t AS (SELECT DISTINCT lower(split_part(p_name,' ',1))||p_size AS term FROM part), s AS (SELECT lower(split_part(p_name,' ',1))||p_size AS term, CASE p_partkey%3 WHEN 0 THEN 'ko' WHEN 1 THEN 'en' ELSE 'de' END AS lang,
  CASE WHEN p_partkey%5=0 THEN p_brand||' item. More text.' ELSE 'A '||lower(split_part(p_name,' ',1))||p_size||' is sold as '||p_type||'. Second part.' END AS summary FROM part),
 b AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY CASE lang WHEN 'ko' THEN 0 ELSE 1 END, summary) rn FROM s WHERE lang IN ('ko','en')),
 c AS (SELECT term, trim(regexp_extract(left(summary,220),'^(.*?[.!?])(?:\s|$)',1)) AS f FROM b WHERE rn=1)
 SELECT term, answer FROM (SELECT term, CASE WHEN contains(lower(f), term) THEN f ELSE term||'는 '||f END AS answer FROM c JOIN t USING (term)) WHERE length(answer)>=20""")
def _(t):
    term = F.concat(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))), F.col("p_size").cast("string"))
    p = t.part.withColumn("term", term)
    k = F.col("p_partkey")
    s = p.select("term", F.when(k % 3 == 0, "ko").when(k % 3 == 1, "en").otherwise("de").alias("lang"),
                 F.when(k % 5 == 0, F.concat("p_brand", F.lit(" item. More text."))).otherwise(F.concat(F.lit("A "), "term", F.lit(" is sold as "), "p_type", F.lit(". Second part."))).alias("summary"))
    return J.term_summaries(p.select("term"), s, "term", "lang", "summary")


# ------------------------------------------------------------------ aggregations

REASON = "CASE WHEN n_chars<200 THEN 'short' WHEN n_chars>5000 THEN 'long' WHEN lang='de' THEN 'language' ELSE 'ok' END"


@case("a01_reject_counts", f"SELECT r AS reason, source, count(*)::BIGINT AS n FROM (SELECT {REASON} AS r, source FROM documents) GROUP BY GROUPING SETS ((r, source), (r))")
def _(t):
    r = R.first_reason([("short", F.col("n_chars") < 200), ("long", F.col("n_chars") > 5000), ("language", F.col("lang") == "de")])
    return A.reject_rollup(t.documents.select("source", F.coalesce(r, F.lit("ok")).alias("reason")), "source", "reason")


@case("a02_source_accounting", "SELECT source, count(*)::BIGINT AS read, count(*) FILTER (contains(text,'MIT License'))::BIGINT AS licensed, count(*) FILTER (n_chars>1000)::BIGINT AS kept FROM documents GROUP BY source")
def _(t):
    return A.source_accounting(t.documents, "source", licensed=F.col("text").contains("MIT License"), kept=F.col("n_chars") > 1000)


@case("a03_label_counts", """SELECT label, value, count(*)::BIGINT AS n FROM (SELECT 'lang' AS label, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY ALL""")
def _(t):
    return A.label_counts(t.documents.select("lang", "source"), ["lang", "source"])


@case("a04_top_n_counts", "SELECT user_id, count(*)::BIGINT AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 25")
def _(t):
    return A.top_counts(t.events, "user_id", 25)


@case("a05_symbol_profile", f"SELECT ch, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text,'[{SYM}]')) AS ch FROM documents) GROUP BY ch ORDER BY n DESC, ch LIMIT 40")
def _(t):
    return A.top_symbols(t.documents, "text", 40, LATIN)


@case("a06_score_by_file", f"SELECT source, {rnd('avg(quality)')} AS mean_quality, count(*)::BIGINT AS n FROM documents JOIN labels USING (doc_id) GROUP BY source")
def _(t):
    d = t.documents.select(D, "source").join(t.labels, D)
    return d.groupBy("source").agg(r6(F.avg("quality")).alias("mean_quality"), F.count("*").alias("n")).orderBy(F.col("mean_quality").desc())


@case("a07_stage_stats", f"""SELECT lang AS stage, count(*)::BIGINT AS rows, sum(strlen(text))::BIGINT AS tokens, CASE lang WHEN 'en' THEN 2000000 WHEN 'fr' THEN 500000 ELSE 300000 END::BIGINT AS budget,
 {rnd("sum(strlen(text))::DOUBLE/CASE lang WHEN 'en' THEN 2000000 WHEN 'fr' THEN 500000 ELSE 300000 END")} AS utilization FROM documents GROUP BY lang""")
def _(t):
    d = t.documents.select(F.col("lang").alias("stage"), F.octet_length("text").alias("tokens"))
    s = A.stage_stats(d, "stage", "tokens", {"en": 2_000_000, "fr": 500_000, "de": 300_000, "es": 300_000})
    return s.withColumn("utilization", r6(F.col("utilization")))


@case("a08_dataset_fingerprint", "SELECT count(*)::BIGINT AS rows, sum(strlen(source)+strlen(lang)+strlen(text))::BIGINT AS bytes, sum(('0x'||substr(md5(concat_ws(chr(31), source, lang, text)),1,12))::HUGEINT)::VARCHAR AS digest FROM documents")
def _(t):
    return A.content_digest(t.documents, "source", "lang", "text")


@case("a09_preview_stats", "WITH p AS (SELECT length(text) AS c, strlen(text)+2 AS t FROM documents ORDER BY doc_id LIMIT 256) SELECT count(*)::BIGINT AS records, round(avg(c),2) AS mean_chars, round(avg(t),2) AS mean_tokens, round(stddev_pop(c),4) AS std_chars FROM p")
def _(t):
    return A.preview_stats(t.documents, F.length("text"), F.octet_length("text") + 2, D)


@case("a10_field_summary", "SELECT lang AS field, count(*)::BIGINT AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY lang")
def _(t):
    return A.field_summary(t.documents.select(F.col("lang").alias("field"), F.octet_length("text").alias("size")), "field", "size")


MARK = r"(?i)(?:최종답|정답|답|결론)\s*(?::|은)\s*([^\n]+)"


def answer_sql(c):
    s = f"replace({strp(c)}, chr(13), chr(10))"
    pick = f"""CASE WHEN len(regexp_extract_all({s}, '{MARK}', 1))>0 THEN {strp(f"regexp_extract_all({s}, '{MARK}', 1)[-1]")} ELSE coalesce(list_filter(list_transform(string_split({s}, chr(10)), lambda x: {strp('x')}), lambda y: y<>'')[-1], '') END"""
    a = strp(f"regexp_replace({strp(pick)}, '^`+|`+$', '', 'g')")
    a = strp(f"regexp_replace({a}, '(?:입니다|이다|임)$', '')")
    a = strp(f"regexp_replace({a}, '^\\.+|\\.+$', '', 'g')")
    return f"replace(replace({a}, ' ', ''), ',', '')"


def canon_sql(a):
    def inl(v):
        return "(" + ",".join(f"'{x}'" for x in v) + ")"

    return f"""CASE WHEN lower({a}) IN {inl(Q.YES)} THEN '예' WHEN lower({a}) IN {inl(Q.NO)} THEN '아니오' WHEN lower({a}) IN {inl(Q.UNKNOWN)} THEN '알 수 없음'
 WHEN regexp_matches({a}, '^-?\\d+\\.0+$') THEN split_part({a},'.',1) WHEN regexp_matches(lower({a}), '^[a-d]$') THEN upper({a}) ELSE {a} END"""


GOLD = "CASE o_orderkey%3 WHEN 0 THEN 'A' WHEN 1 THEN '보장할 수 없다' ELSE o_custkey||'.0' END"


@case("a11_exact_match", f"""WITH {ANS}, g AS (SELECT a.*, {GOLD} AS gold0 FROM ans a JOIN orders o USING (o_orderkey)), n AS (SELECT checkpoint, id, {answer_sql('stdout')} AS p0, {answer_sql('gold0')} AS g0, regexp_matches(stdout, '{MARK}') AS ex FROM g),
 m AS (SELECT checkpoint, id, ex, {canon_sql('p0')} AS p, {canon_sql('g0')} AS gold FROM n)
 SELECT checkpoint, id, count(*)::BIGINT AS count, {rnd("avg((p<>'' AND p=gold)::INT)")} AS exact_match, {rnd("avg((p<>'')::INT)")} AS parse_rate, {rnd('avg(ex::INT)')} AS explicit_rate FROM m GROUP BY GROUPING SETS ((checkpoint, id), (checkpoint))""")
def _(t):
    k = F.col("o_orderkey") % 3
    o = t.orders.select("o_orderkey", F.when(k == 0, "A").when(k == 1, "보장할 수 없다").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("gold"))
    d = answers(t).join(o, "o_orderkey")
    e = A.exact_match(d, "checkpoint", "id", Q.normalize_answer("gold"), Q.normalize_answer("stdout"), Q.has_explicit_answer("stdout"))
    return e.select("checkpoint", "id", "count", *[r6(F.col(c)).alias(c) for c in ("exact_match", "parse_rate", "explicit_rate")])


WEIRD = "[^\\s0-9A-Za-z가-힣,?!:;()\\-_/\"''~`]"
TK = "regexp_extract_all(lower(s), '[0-9A-Za-z가-힣]+')"
FLAGS = f"""{ANS}, f0 AS (SELECT *, {norm('stdout')} AS s, {match_sql()} AS matches FROM ans), f1 AS (SELECT *, {TK} AS tk FROM f0),
 tc AS (SELECT o_orderkey, max(n) AS top FROM (SELECT o_orderkey, w, count(*) n FROM (SELECT o_orderkey, unnest(tk) AS w FROM f1) GROUP BY ALL) GROUP BY ALL),
 bc AS (SELECT o_orderkey, max(n) AS big FROM (SELECT o_orderkey, b, count(*) n FROM (SELECT o_orderkey, unnest(list_zip(tk[1:len(tk)-1], tk[2:])) AS b FROM f1 WHERE len(tk)>1) GROUP BY ALL) GROUP BY ALL),
 f2 AS (SELECT f1.*, regexp_matches(id,'^(?:chat_|def_|qa_)') AS general, starts_with(id,'logic_') AS logic,
  s='' OR {words_in('s', Q.ARITHMETIC_MARKS)} OR regexp_matches(s,'\\d{{4,}}') OR (length(s)>=12 AND len(list_distinct(string_split(s,'')))<=3)
  OR len(regexp_extract_all(s,'{WEIRD}'))::DOUBLE/greatest(1,length(s))>0.08 OR len(regexp_extract_all(s,'\\d'))::DOUBLE/greatest(1,length(s))>0.22
  OR (len(tk)>=6 AND ((top>=4 AND top::DOUBLE/len(tk)>=0.22) OR coalesce(big,0)>=3)) OR (regexp_matches(id,'^(?:chat_|def_|qa_)') AND NOT regexp_matches(s,'[가-힣]')) OR NOT matches AS collapse
  FROM f1 LEFT JOIN tc USING (o_orderkey) LEFT JOIN bc USING (o_orderkey)),
 flags AS (SELECT *, {words_in('stdout', Q.UNKNOWN_MARKS)} AS unknown, returncode=0 AND NOT collapse AND matches AS passed,
  CASE id {' '.join(f"WHEN '{k}' THEN ({'+'.join(f'''contains(lower(s),'{w}')::INT''' for w in v)})/{len(v)}.0" for k, v in Q.DEFINITION_TERMS.items())} END::DOUBLE AS relevance FROM f2)"""


def flagged(t):
    d = J.with_expectations(answers(t), J.expectation_frame(t.spark, EXP))
    d = d.withColumn("collapse", Q.collapse_flag("id", "stdout", F.col("matches")))
    return d.select("o_orderkey", "checkpoint", "id", Q.is_general_item("id").alias("general"), Q.is_logic_item("id").alias("logic"), "collapse",
                    R.has_any(F.col("stdout"), Q.UNKNOWN_MARKS).alias("unknown"), ((F.col("returncode") == 0) & ~F.col("collapse") & F.col("matches")).alias("passed"),
                    Q.definition_relevance("id", "stdout").alias("relevance"))


METRICS = ("general_prompt_suite_pass_rate", "collapse_rate", "unknown_rate", "definition_relevance_score", "logic_reasoning_readout_rate")
SUITE = f"""{FLAGS}, suite AS (SELECT checkpoint, coalesce(avg(passed::INT) FILTER (general),0) AS general_prompt_suite_pass_rate, coalesce(avg(collapse::INT) FILTER (general),1) AS collapse_rate,
  coalesce(avg(unknown::INT) FILTER (general),0) AS unknown_rate, coalesce(avg(relevance) FILTER (general),0) AS definition_relevance_score, coalesce(avg(passed::INT) FILTER (logic),0) AS logic_reasoning_readout_rate FROM flags GROUP BY checkpoint)"""


@case("a12_suite_metrics", f"WITH {SUITE} SELECT checkpoint, {', '.join(f'{rnd(m)} AS {m}' for m in METRICS)} FROM suite")
def _(t):
    return A.suite_metrics(flagged(t), "checkpoint").select("checkpoint", *[r6(F.col(m)).alias(m) for m in METRICS])


@case("a13_promotion_gate", f"""WITH {SUITE}, g AS (SELECT *, (substr(checkpoint,3)::INT)/10.0 AS ex FROM suite), d AS (SELECT checkpoint, list_filter([CASE WHEN ex<0.10 THEN 'logic_exact below threshold' END, CASE WHEN general_prompt_suite_pass_rate<0.05 THEN 'general prompt suite pass too low' END,
  CASE WHEN collapse_rate>0.97 THEN 'collapse rate too high' END, CASE WHEN definition_relevance_score<0.19 THEN 'definition relevance too low' END], lambda x: x IS NOT NULL) AS r FROM g)
 SELECT checkpoint, CASE WHEN len(r)=0 THEN 'promote' ELSE 'hold' END AS decision, array_to_string(r,'; ') AS reasons, coalesce((SELECT min(checkpoint) FROM d WHERE len(r)=0),'') AS winner FROM d""")
def _(t):
    m = A.suite_metrics(flagged(t), "checkpoint").withColumn("logic_exact_match", F.substring("checkpoint", 3, 9).cast("int") / 10.0)
    g = A.promotion_gate(m, "checkpoint", {"general_prompt_suite_pass_rate_min": 0.05, "collapse_rate_max": 0.97, "definition_relevance_score_min": 0.19})
    return g.select("checkpoint", "decision", F.array_join("reasons", "; ").alias("reasons"), "winner")


@case("a14_spec_eval_by_tier", f"""WITH {PAIRS}, s AS (SELECT CASE tier WHEN 'high' THEN 'hard' WHEN 'mid' THEN 'soft' ELSE 'observational' END AS tier, length(input)>40 AS h, length(output)>1500 AS s FROM pairs)
 SELECT tier, count(*)::BIGINT AS n, {rnd('avg(h::INT)')} AS hard_rate, {rnd('avg(s::INT)')} AS soft_rate, {rnd('avg((h OR s)::INT)')} AS any_rate FROM s GROUP BY GROUPING SETS ((tier), ())""")
def _(t):
    p = t.pairs.select(X.tier_hardness("tier").alias("tier"), (F.length("input") > 40).alias("h"), (F.length("output") > 1500).alias("s"))
    e = A.spec_eval(p, "tier", F.col("h"), F.col("s"))
    return e.select("tier", "n", *[r6(F.col(c)).alias(c) for c in ("hard_rate", "soft_rate", "any_rate")])


@case("a15_case_score_average", f"""WITH {ANS}, s AS (SELECT checkpoint, length(stdout)/60.0 AS sc FROM ans), a AS (SELECT avg(sc) FILTER (checkpoint='ck1') AS c, avg(sc) FILTER (checkpoint='ck2') AS b FROM s)
 SELECT {rnd('c')} AS candidate, {rnd('b')} AS baseline, {rnd('c/greatest(1e-6,b)')} AS ratio, {rnd('(c-b)*100')} AS gain FROM a""")
def _(t):
    d = answers(t).select("checkpoint", (F.length("stdout") / 60.0).alias("sc"))
    return A.compare_averages(d, "checkpoint", "sc", "ck1", "ck2").select(*[r6(F.col(c)).alias(c) for c in ("candidate", "baseline", "ratio", "gain")])


@case("a16_group_mean_vector", f"""WITH u AS (SELECT label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))) AS n FROM embeddings), x AS (SELECT label, unnest(range(0,64)) AS pos, embedding, n FROM u),
 m AS (SELECT label, pos, avg(embedding[pos+1]::DOUBLE/n) AS v FROM x GROUP BY ALL), z AS (SELECT *, sqrt(sum(v*v) OVER (PARTITION BY label)) AS nn FROM m) SELECT label::BIGINT AS label, pos::BIGINT AS pos, {rnd('v/nn')} AS value FROM z""")
def _(t):
    g = A.group_mean_vectors(t.embeddings.select(F.col("label").cast("long").alias("label"), "embedding"), "label", "embedding")
    return g.select("label", F.col("pos").cast("long").alias("pos"), r6(F.col("value")).alias("value"))


@case("a16_group_principal_vector", f"""WITH RECURSIVE u AS (SELECT vec_id, label::BIGINT AS label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)),
 p AS (SELECT vec_id, label, unnest(range(0, 64)) AS i, unnest(v) AS x FROM u), m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM p GROUP BY ALL),
 c AS (SELECT label, i, j, avg(x * y) - any_value(mi.m) * any_value(mj.m) AS c FROM (SELECT a.label, a.i, b.i AS j, a.x, b.x AS y FROM p a JOIN p b USING (vec_id, label)) z JOIN m mi USING (label, i) JOIN (SELECT label, i AS j, m FROM m) mj USING (label, j) GROUP BY label, i, j),
 r AS (SELECT label, list(q ORDER BY i) AS a FROM (SELECT label, i, list(c ORDER BY j) AS q FROM c GROUP BY label, i) GROUP BY label),
 s AS (SELECT label, 0 AS k, a FROM r UNION ALL SELECT label, k + 1, list_transform(a, lambda x: list_transform(a, lambda y: list_dot_product(x, y) / t)) FROM (SELECT *, list_sum(list_transform(a, lambda x: list_dot_product(x, x))) AS t FROM s WHERE k < 22)),
 d AS (SELECT label, a, list_transform(range(1, 65), lambda k: a[k][k]) AS g FROM s WHERE k = 22), w AS (SELECT label, a[list_position(g, list_max(g))] AS w FROM d), l AS (SELECT label, list(m ORDER BY i) AS mean, any_value(n) AS n FROM m GROUP BY label),
 o AS (SELECT label, CASE WHEN n < 3 THEN list_transform(mean, lambda x: x / sqrt(list_dot_product(mean, mean))) ELSE list_transform(w, lambda x: x * sign(list_dot_product(w, mean)) / sqrt(list_dot_product(w, w))) END AS v FROM w JOIN l USING (label))
 SELECT label, pos::BIGINT AS pos, {rnd('v[pos + 1]')} AS value FROM (SELECT label, v, unnest(range(0, 64)) AS pos FROM o)""")
def _(t):
    g = A.group_principal_vectors(t.embeddings.select(F.col("label").cast("long").alias("label"), "embedding"), "label", "embedding", 64)
    return g.select("label", F.posexplode("value").alias("pos", "value")).select("label", F.col("pos").cast("long").alias("pos"), r6(F.col("value")).alias("value"))


@case("a17_mix_accounting", "SELECT c_mktsegment AS tag, count(*)::BIGINT AS rows FROM customer GROUP BY ALL")
def _(t):
    return A.mix_accounting(t.customer.select(F.col("c_mktsegment").alias("tag")), "tag")


# ------------------------------------------------------------------ windows


@case("w01_first_wins", """SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) rn FROM events) WHERE rn=1""")
def _(t):
    from pairmill.operators.dedup import first_wins

    return first_wins(t.events.select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@case("w02_running_cap", """SELECT event_id, event_type, r::BIGINT AS place FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) r FROM events) WHERE r<=1500""")
def _(t):
    from pairmill.operators.sample import position_ranked

    return position_ranked(t.events.select("event_id", "event_type"), "event_id", ["event_type"], "place", limit=F.lit(1500)).withColumn("place", F.col("place").cast("long"))


@case("w03_dialog_pairs", f"WITH {CHAT} SELECT * FROM chat")
def _(t):
    return t.chat


@case("w04_alternating_pairs", """WITH s AS (SELECT doc_id, string_split(text, '. ') AS a FROM documents), x AS (SELECT doc_id, a, unnest(range(0, (len(a)//2)::BIGINT)) AS pos FROM s) SELECT doc_id, pos, a[2*pos+1] AS input, a[2*pos+2] AS output FROM x""")
def _(t):
    d = t.documents.select(D, F.explode(W.alternating_pairs(F.split("text", r"\. "))).alias("p"))
    return d.select(D, F.col("p.pos").cast("long").alias("pos"), "p.input", "p.output")


@case("w05_best_of_candidates", """SELECT l_orderkey, l_linenumber::BIGINT AS pos, l_extendedprice AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) rn FROM lineitem) WHERE rn=1""")
def _(t):
    l = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("pos"), F.col("l_extendedprice").alias("score"), "l_partkey")
    return W.best_of(l, ["l_orderkey"], "score", F.struct("pos", "l_partkey")).drop("l_partkey")


@case("w06_leaderboard", f"""WITH c AS (SELECT user_id, event_type, event_id, value/40.0 AS loss, floor(epoch(ts))::BIGINT AS m, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END DESC, event_id) rn FROM events),
 b AS (SELECT * FROM c WHERE rn=1), z AS (SELECT min(m) AS lo, max(m) AS hi FROM b), s AS (SELECT user_id, 0.88*(3.0-least(greatest(loss,0),3))/3.0+0.12*CASE WHEN hi<=lo THEN 0.5 ELSE (m-lo)::DOUBLE/(hi-lo) END AS meta, CASE WHEN user_id%2=0 THEN (user_id%10)/10.0 END AS probe FROM b, z),
 f AS (SELECT user_id, CASE WHEN probe IS NULL THEN 0.95*meta ELSE 0.68*meta+0.32*probe END AS fin FROM s) SELECT user_id, {rnd('fin')} AS score, rank() OVER (ORDER BY round(fin,9) DESC)::BIGINT AS place FROM f""")
def _(t):
    prio = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    best = W.best_of(t.events, ["user_id"], prio, "event_id").select("user_id", (F.col("value") / 40.0).alias("loss"), F.unix_timestamp("ts").alias("mtime"))
    bounds = best.agg(F.min("mtime").alias("oldest"), F.max("mtime").alias("newest"))
    s = W.meta_score(best, "loss", "mtime", bounds).withColumn("score", W.total_score(F.col("meta_score"), F.when(F.col("user_id") % 2 == 0, F.col("user_id") % 10 / 10.0)))
    return W.leaderboard(s, "score", "user_id").select("user_id", r6(F.col("score")).alias("score"), F.col("place").cast("long").alias("place"))


@case("w07_consensus", f"""WITH c AS (SELECT source, doc_id, {rtoks('text')} AS k, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) r FROM documents), a AS (SELECT source, k FROM c WHERE r=1)
 SELECT a.source, {rnd(f"CASE WHEN len(a.k)=0 THEN 0 ELSE avg(CASE WHEN len(c.k)=0 THEN 0 ELSE len(list_intersect(a.k,c.k))::DOUBLE/greatest(1,len(a.k)+len(c.k)-len(list_intersect(a.k,c.k))) END) END")} AS consensus FROM a JOIN c ON c.source=a.source AND c.r BETWEEN 2 AND 4 GROUP BY a.source, a.k""")
def _(t):
    c = t.documents.select("source", D, X.retrieval_tokens("text", LATIN).alias("k"), "n_chars")
    return W.consensus(c, "source", [F.col("n_chars").desc(), F.col(D)], "k").select("source", r6(F.col("consensus")).alias("consensus"))


PARA = f"list_filter(list_transform(string_split_regex(text, '\\n'), lambda x: {norm('x')}), lambda y: length(y)>=60)"


@case("w08_chunk_overlap_split", f"""WITH RECURSIVE p AS (SELECT doc_id, {PARA} AS ps FROM documents), f AS (SELECT doc_id, ps, 0::BIGINT AS i, []::VARCHAR[] AS done, ''::VARCHAR AS buf FROM p UNION ALL
  SELECT doc_id, ps, i+1, CASE WHEN length(buf)>=500 AND length(buf)+length(ps[i+1])+(length(buf)>0)::INT*2>1500 THEN list_append(done, buf) ELSE done END,
  CASE WHEN length(buf)>=500 AND length(buf)+length(ps[i+1])+(length(buf)>0)::INT*2>1500 THEN ps[i+1] WHEN length(buf)>0 THEN buf||chr(10)||chr(10)||ps[i+1] ELSE ps[i+1] END FROM f WHERE i<len(ps)),
 e AS (SELECT doc_id, CASE WHEN length(buf)>=500 THEN list_append(done, buf) ELSE done END AS c FROM f WHERE i=len(ps)), x AS (SELECT doc_id, unnest(c[1:24]) AS c, generate_subscripts(c[1:24],1)-1 AS pos FROM e),
 s AS (SELECT *, least(greatest(floor(length(c)*0.55)::INT,120), length(c)-120) AS cut FROM x)
 SELECT doc_id, pos::BIGINT AS pos, {strp('left(c, cut)')} AS input, {strp('substr(c, cut+1)')} AS output FROM s""")
def _(t):
    paras = F.filter(F.transform(F.split("text", "\n"), X.normalize_space), lambda p: F.length(p) >= 60)
    d = t.documents.select(D, F.posexplode(F.slice(W.chunk_paragraphs(paras), 1, 24)).alias("pos", "c"))
    left, right = W.cut_at(F.col("c"), 0.55, 120)
    return d.select(D, F.col("pos").cast("long").alias("pos"), left.alias("input"), right.alias("output"))


# ------------------------------------------------------------------ scores


@case("q01_quality_score", rf"""WITH {CHAT}, m AS (SELECT conv_id, turn, {norm('input')} AS q, {norm('output')} AS a, {kterms(norm('input'), WST.fillers)} AS qt, {kterms(norm('output'), WST.fillers)} AS ot, CASE conv_id%3 WHEN 0 THEN 'high' WHEN 1 THEN 'mid' ELSE '' END AS tier FROM chat),
 b AS (SELECT *, q||chr(10)||a AS b FROM m) SELECT conv_id, turn, {rnd(f"least(length(a),260)/260.0+0.9*({div(cnt('b', SYM), cnt('b', LET))})+1.1*({div('len(list_intersect(qt,ot))', 'len(qt)')})+CASE tier WHEN 'high' THEN 0.45 WHEN 'mid' THEN 0.20 ELSE 0 END+CASE WHEN {rx('q', WST.logic)} AND {rx('a', WST.reason_words)} THEN 0.30 ELSE 0 END+CASE WHEN {rx('q', WST.math)} AND regexp_matches(a,'[0-9]') THEN 0.22 ELSE 0 END+CASE WHEN {rx('q', WST.syllogism)} AND {rx('a', WST.syllogism_score_words)} THEN 0.22 ELSE 0 END")} AS score FROM b""")
def _(t):
    tier = F.when(F.col("conv_id") % 3 == 0, "high").when(F.col("conv_id") % 3 == 1, "mid").otherwise("")
    return t.chat.select("conv_id", "turn", r6(Q.quality_score("input", "output", tier, LATIN, WST)).alias("score"))


@case("q02_vocab_sample_weight", f"""SELECT p_partkey, {rnd("greatest(0.05, 1.0+0.55*(p_size/10.0)+CASE WHEN p_partkey%4>0 THEN 0.18 ELSE 0 END+CASE p_partkey%3 WHEN 0 THEN 0.22 WHEN 1 THEN 0.10 ELSE 0 END)")} AS weight FROM part""")
def _(t):
    k = F.col("p_partkey")
    tier = F.when(k % 3 == 0, "high").when(k % 3 == 1, "mid").otherwise("base")
    return t.part.select("p_partkey", r6(Q.vocab_sample_weight(F.col("p_size") / 10.0, k % 4, tier)).alias("weight"))


@case("q03_tier_uplift", f"""WITH {PAIRS}, m AS (SELECT doc_id, CASE tier WHEN 'high' THEN 2 WHEN 'mid' THEN 1 ELSE 0 END AS r, doc_id%4 AS h, doc_id%3 AS o FROM pairs), g AS (SELECT doc_id, greatest(r, CASE WHEN h>=2 OR (h>=1 AND o>0) THEN 2 WHEN h>=1 THEN 1 ELSE 0 END) AS g FROM m)
 SELECT doc_id, CASE WHEN g>=2 THEN 'high' WHEN g=1 THEN 'mid' ELSE 'base' END AS tier FROM g""")
def _(t):
    return t.pairs.select(D, Q.tier_uplift("tier", F.col(D) % 4, F.col(D) % 3).alias("tier"))


@case("q04_term_answer_score", rf"""WITH s0 AS (SELECT page_id, replace(replace({norm("regexp_replace(html, '<[^>]+>', ' ', 'g')")}, ' ,', ','), ' .', '.') AS s, split_part(url,'/',4) AS term FROM pages),
 c AS (SELECT page_id, term, s, trim(regexp_extract(left(s,220),'^(.*?[.!?])(?:\s|$)',1)) AS f FROM s0), d AS (SELECT page_id, term, s, CASE WHEN length(f)>=4 THEN f ELSE trim(left(s,220)) END AS cut FROM c),
 e AS (SELECT page_id, term, CASE WHEN contains(s,chr(65533)) OR length(s)-length(replace(s,'?',''))>=greatest(3,length(s)//18) OR length(cut)<12 OR ({cnt('cut', SYM)}<2 AND {cnt('cut','A-Za-z')}<8) THEN '' ELSE cut END AS a FROM d)
 SELECT page_id, a AS answer, CASE WHEN term<>'' AND contains(lower(a), lower(term)) THEN 1 ELSE 0 END::BIGINT AS names_term, {cnt('a', SYM)} AS symbols, (-abs(length(a)-80))::BIGINT AS closeness FROM e""")
def _(t):
    d = t.pages.select("page_id", F.split_part("url", F.lit("/"), F.lit(4)).alias("term"), Q.clean_answer("html", LATIN).alias("answer"))
    n, s, c = Q.term_answer_score("term", "answer", LATIN)
    return d.select("page_id", "answer", n.cast("long").alias("names_term"), s.alias("symbols"), c.cast("long").alias("closeness"))


@case("q05_term_source_score", """WITH s AS (SELECT p_partkey, p_name, split_part(p_name,' ',1) AS term, CASE p_brand WHEN 'Brand#2' THEN 90 WHEN 'Brand#17' THEN 80 ELSE 0 END AS pr, -abs(length(split_part(p_name,' ',1))-6) AS l, -length(p_name||p_type) AS a FROM part)
 SELECT term, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY pr DESC, l DESC, a DESC, p_partkey) rn FROM s) WHERE rn=1""")
def _(t):
    from pairmill.operators.dedup import best_per_term

    p = t.part.select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("term"), F.concat("p_name", "p_type").alias("answer"), F.concat(F.lit("data/"), "p_brand").alias("source"))
    return best_per_term(p, "term", Q.term_source_score("term", "answer", "source", {"brand#2": 90, "brand#17": 80}), "p_partkey").select("term", "p_partkey")


@case("q05_term_usable", r"""WITH x AS (SELECT p_partkey, CASE p_partkey%6 WHEN 0 THEN p_name WHEN 1 THEN '0x'||p_size WHEN 2 THEN '--- __' WHEN 3 THEN p_size||'.5' WHEN 4 THEN 'ab' ELSE p_brand END AS t FROM part)
 SELECT p_partkey, length(t) BETWEEN 2 AND 48 AND NOT (regexp_matches(t,'^0x[0-9a-f]+$') OR regexp_matches(t,'^[^A-Za-z0-9]+$') OR regexp_matches(t,'^[0-9.\-_/]+$')) AND regexp_matches(t,'[A-Za-z]') AND length(t)>=3 AS usable FROM x""")
def _(t):
    k = F.col("p_partkey") % 6
    size = F.col("p_size").cast("string")
    term = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("0x"), size)).when(k == 2, "--- __").when(k == 3, F.concat(size, F.lit(".5"))).when(k == 4, "ab").otherwise(F.col("p_brand"))
    return t.part.select("p_partkey", Q.term_usable(term).alias("usable"))


IQ, OA = f"lower({strp('input')})", strp("output")


@case("q06_relevance_score", rf"""WITH {CHAT}, m AS (SELECT conv_id, turn, {strp('input')} AS q, {OA} AS r, {rtoks(strp('input'))} AS qt, {rtoks(OA)} AS rt, {kterms(strp('input'), WST.fillers)} AS keys, {solver(IQ, WST)} AS solv, {solver(IQ, WST)} OR {words_in(IQ, WST.fact_words)} AS fact,
   {cnt(strp('input'), SYM)} AS ns FROM chat), h AS (SELECT *, len(list_intersect(qt,rt)) AS i, len(list_filter(keys, lambda k: contains(lower(r),k))) AS hit FROM m)
 SELECT conv_id, turn, {rnd("CASE WHEN r='' THEN -1.0 ELSE least(length(r),240)/240.0+CASE WHEN len(qt)>0 AND len(rt)>0 THEN 2.0*i/len(qt)+1.0*i/greatest(1,len(qt)+len(rt)-i) ELSE 0 END+CASE WHEN solv AND regexp_matches(r,'[0-9]') THEN 0.5 ELSE 0 END+CASE WHEN len(keys)>0 THEN 0.9*hit/len(keys)-CASE WHEN hit=0 AND NOT fact THEN 0.8 ELSE 0 END ELSE 0 END-CASE WHEN ns>0 THEN 1.75*0.04 ELSE 0 END END")} AS score FROM h""")
def _(t):
    return t.chat.select("conv_id", "turn", r6(Q.relevance_score("input", "output", F.lit(0.04), LATIN, WST)).alias("score"))


@case("q06_alignment_bonus", rf"""WITH {QA}, m AS (SELECT p_partkey, input AS q, output AS r, CASE p_partkey%8 WHEN 0 THEN lower(split_part(p_name,' ',1)) WHEN 1 THEN lower(split_part(p_name,' ',2)) WHEN 3 THEN '이유를' WHEN 6 THEN '간단히' ELSE '' END AS t0 FROM qa JOIN part USING (p_partkey))
 SELECT p_partkey, {rnd(f"CASE WHEN {rx('q', KOREAN.definition)} AND p_partkey%8 IN (0,1) THEN CASE WHEN contains(lower(r), t0) THEN 1.20 ELSE -1.45 END WHEN {rx('q', KOREAN.definition)} THEN -1.45 ELSE 0 END + CASE WHEN {rx('q', KOREAN.logic)} THEN CASE WHEN {rx('r', KOREAN.reason_words)} THEN 0.45 ELSE -0.60 END ELSE 0 END - CASE WHEN {rx('r', ci(KOREAN.intro_answer_ci))} AND NOT {rx('q', ci(KOREAN.intro_query_ci))} THEN 1.0 ELSE 0 END")} AS bonus FROM m""")
def _(t):
    return t.qa.select("p_partkey", r6(Q.alignment_bonus("input", "output")).alias("bonus"))


SW = "list_distinct(regexp_extract_all(lower({c}), '[" + TOK + "_]{{2,}}'))"


@case("q07_soft_judge", f"""WITH {CHAT}, m AS (SELECT conv_id, turn, {strp('input')} AS t, {OA} AS r, {SW.format(c=strp('input'))} AS a, {SW.format(c=OA)} AS b, lower({norm('input')}) AS tn, lower({norm('output')}) AS rn FROM chat),
 s AS (SELECT conv_id, turn, CASE WHEN t='' OR r='' THEN 0 ELSE 0.55*{jac('a','b')}+CASE WHEN contains(rn,left(tn,48)) OR contains(tn,left(rn,48)) THEN 0.25 ELSE 0 END+0.20*least(length(t),length(r))::DOUBLE/greatest(length(t),length(r),1) END AS s FROM m)
 SELECT conv_id, turn, {rnd('s')} AS soft, {rnd('s+CASE WHEN turn%4=1 THEN 2.0 ELSE 0 END')} AS objective FROM s""")
def _(t):
    d = t.chat.withColumn("s", Q.soft_judge("input", "output", LATIN))
    return d.select("conv_id", "turn", r6(F.col("s")).alias("soft"), r6(Q.objective(F.col("turn") % 4 == 1, F.col("s"))).alias("objective"))


@case("q08_verifier", rf"""WITH {QA}, m AS (SELECT p_partkey, CASE p_partkey%3 WHEN 0 THEN 'exact' WHEN 1 THEN 'contains' ELSE 'regex' END AS k, lower({norm('output')}) AS r, output, lower({norm("CASE WHEN p_partkey%2=0 THEN upper(output)||' ' ELSE input END")}) AS tg, term FROM qa),
 x AS (SELECT *, list_filter([lower(term), 'part', '상태'], lambda w: NOT contains(r, w)) AS miss, CASE WHEN p_partkey%5=0 THEN '' ELSE '[0-9]+' END AS pat FROM m)
 SELECT p_partkey, CASE k WHEN 'exact' THEN r=tg WHEN 'contains' THEN len(miss)=0 ELSE pat<>'' AND regexp_matches(output, '[0-9]+') END AS ok,
 CASE k WHEN 'exact' THEN CASE WHEN r=tg THEN '' ELSE 'exact_mismatch' END WHEN 'contains' THEN CASE WHEN len(miss)=0 THEN '' ELSE 'missing:'||array_to_string(miss[1:4],',') END ELSE CASE WHEN pat='' THEN 'empty_regex' WHEN regexp_matches(output,'[0-9]+') THEN '' ELSE 'regex_mismatch' END END AS reason FROM x""")
def _(t):
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "exact").when(k % 3 == 1, "contains").otherwise("regex")
    target = F.when(k % 2 == 0, F.concat(F.upper("output"), F.lit(" "))).otherwise(F.col("input"))
    v = Q.verify(kind, F.array(F.col("term"), F.lit("part"), F.lit("상태")), F.when(k % 5 == 0, "").otherwise("[0-9]+"), target, "output")
    return t.qa.select("p_partkey", v.alias("v")).select("p_partkey", "v.ok", "v.reason")


@case("q09_normalize_answer", f"WITH {ANS}, n AS (SELECT o_orderkey, stdout, {answer_sql('stdout')} AS a FROM ans) SELECT o_orderkey, {canon_sql('a')} AS answer, regexp_matches(stdout, '{MARK}') AS explicit FROM n")
def _(t):
    return answers(t).select("o_orderkey", Q.normalize_answer("stdout").alias("answer"), Q.has_explicit_answer("stdout").alias("explicit"))


@case("q10_case_score", rf"""WITH {CHAT}, m AS (SELECT conv_id, turn, {OA} AS r, {kterms('input')} AS q, {kterms(OA)} AS a, {toks(OA)} AS w, conv_id%5=0 AS eu FROM chat), h AS (SELECT *, len(list_intersect(q,a)) AS sh, (contains(lower(r),'the')::INT+contains(lower(r),'que')::INT+contains(lower(r),'zzz')::INT) AS hits,
  {rx('r', WST.unknown)} AS unk, {rx('r', ci(WST.intro_answer_ci))} AS intro, {div(cnt('r', SYM), cnt('r', ALNUM))}>=0.55 AS rich, len(w)>=14 AND len(list_distinct(w))::DOUBLE/len(w)<0.34 AS dull FROM m)
 SELECT conv_id, turn, {rnd("greatest(0, least(1, CASE WHEN length(r)>=200 THEN 0.15 ELSE 0 END+CASE WHEN rich THEN 0.15 ELSE 0 END+CASE WHEN len(q)>0 THEN 0.20*sh/len(q) ELSE 0 END+0.40*hits/3.0+CASE WHEN eu AND unk THEN 0.20 WHEN NOT eu AND unk THEN -0.20 ELSE 0 END-CASE WHEN intro THEN 0.30 ELSE 0 END-CASE WHEN dull THEN 0.20 ELSE 0 END))")} AS score,
 array_to_string(list_filter([CASE WHEN length(r)<200 THEN 'too_short' END, CASE WHEN NOT rich THEN 'low_hangul_ratio' END, CASE WHEN len(q)>0 AND sh=0 THEN 'no_keyword_overlap' END, CASE WHEN hits=0 THEN 'expected_terms_missing' END, CASE WHEN eu AND NOT unk THEN 'should_be_unknown' END,
  CASE WHEN NOT eu AND unk THEN 'unexpected_unknown' END, CASE WHEN intro THEN 'intro_leak' END, CASE WHEN dull THEN 'low_diversity' END], lambda x: x IS NOT NULL), ',') AS reasons FROM h""")
def _(t):
    s = Q.case_score("input", "output", F.array(F.lit("the"), F.lit("QUE"), F.lit("zzz")), F.lit(200), F.col("conv_id") % 5 == 0, F.lit(True), LATIN, WST)
    return t.chat.select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", r6(F.col("s.score")).alias("score"), F.array_join("s.reasons", ",").alias("reasons"))


@case("q11_collapse_flag", f"WITH {FLAGS} SELECT o_orderkey, id, collapse, {rnd('relevance')} AS relevance FROM flags")
def _(t):
    return flagged(t).select("o_orderkey", "id", "collapse", r6(F.col("relevance")).alias("relevance"))


def hits_sql(c, words):
    return "(" + "+".join(f"contains({c},'{w}')::INT" for w in words) + ")"


@case("q12_probe_score", rf"""WITH {QA}, m AS (SELECT p_partkey, CASE p_partkey%3 WHEN 0 THEN 'code' WHEN 1 THEN 'math' ELSE 'general' END AS e, CASE WHEN p_partkey%5=0 THEN 'def f(x): return '||output||' 120' ELSE output END AS s FROM qa),
 x AS (SELECT *, least(length(s),120)/120.0 AS sz, regexp_extract_all(lower(s),'[A-Za-z0-9_]+') AS w, p_partkey%8=6 AS run FROM m),
 p AS (SELECT *, CASE WHEN run THEN 0.8 WHEN len(w)>=12 AND len(list_distinct(w))::DOUBLE/len(w)<0.34 THEN 0.55 ELSE 0 END AS pen FROM x)
 SELECT p_partkey, {rnd("greatest(0, CASE e WHEN 'code' THEN 0.60*least(1.0," + hits_sql('s', ('def ', 'return ', '```', 'lambda ', 'function ')) + "/2.0)+0.40*sz WHEN 'math' THEN 0.75*regexp_matches(s,'(?:^|[^0-9A-Za-z가-힣_])120(?:[^0-9A-Za-z가-힣_]|$)')::INT+0.25*regexp_matches(s,'[0-9]')::INT ELSE 0.55*(contains(s,'.') OR contains(s,';') OR len(string_split(s,' '))>=8)::INT+0.45*sz END - pen)")} AS probe,
 {rnd("least(1.0," + hits_sql('lower(s)', ('```', 'def ', 'class ', 'print(', 'function ', 'return ', 'for ', 'while ')) + "/2.0)")} AS code_gate, {rnd("least(1.0," + hits_sql('s', ('체크', '점검', '로그', '학습', '손실', '검증', '데이터', '체크리스트')) + "/2.0)")} AS ops_gate FROM p""")
def _(t):
    k = F.col("p_partkey")
    d = t.qa.select("p_partkey", F.when(k % 3 == 0, "code").when(k % 3 == 1, "math").otherwise("general").alias("e"),
                    F.when(k % 5 == 0, F.concat(F.lit("def f(x): return "), "output", F.lit(" 120"))).otherwise(F.col("output")).alias("s"))
    return d.select("p_partkey", r6(Q.probe_score("e", "s")).alias("probe"), r6(Q.gate_code_score("s")).alias("code_gate"), r6(Q.gate_ops_score("s")).alias("ops_gate"))


def ell(c, n):
    return f"CASE WHEN length({norm(c)})<={n} THEN {norm(c)} ELSE rtrim(left({norm(c)},{max(20, n - 3)}))||'...' END"


@case("q13_rule_candidate_rank", f"""WITH {CHAT}, m AS (SELECT conv_id, turn, {ell('output',220)} AS t, {ell('input',120)} AS p, {ell('output',120)} AS r, {SW.format(c='output')} AS tt, {SW.format(c="'exact_mismatch'")} AS rt FROM chat),
 c AS (SELECT conv_id, turn, tt, rt, unnest([0,1,2]) AS pos, unnest(['If the query is similar to: '||p||chr(10)||'Return content aligned with: '||t, 'Rule from failure(exact_mismatch): prioritize target constraints.'||chr(10)||'Target anchor: '||t,
  'Fix incorrect output pattern.'||chr(10)||'Bad output snippet: '||r||chr(10)||'Expected style/content: '||t]) AS x FROM m), w AS (SELECT *, {SW.format(c='x')} AS w FROM c),
 s AS (SELECT *, round((0.75*{jac('w','tt')}+0.25*{jac('w','rt')}-0.001*greatest(0,length(x)-260))::DOUBLE,9) AS s FROM w), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s DESC, pos) rn FROM s)
 SELECT conv_id, turn, x AS rule, {rnd('s')} AS score FROM b WHERE rn=1""")
def _(t):
    b = Q.best_rule("input", "output", F.col("output"), F.lit("exact_mismatch"), LATIN)
    return t.chat.select("conv_id", "turn", b.alias("b")).select("conv_id", "turn", F.col("b.text").alias("rule"), r6(F.col("b.score")).alias("score"))
