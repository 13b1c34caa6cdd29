"""Deduplication (D), caps, samples, mixes and splits (M)."""

import hashlib

from pyspark.sql import functions as F

from pairmill.catalog.base import CHAT, PAIRS, QA, case, cln, jac, norm, r6, rnd, strp, toks
from pairmill.catalog.shaping import FMT
from pairmill.functions import text as X
from pairmill.operators import dedup as D
from pairmill.operators import sample as S
from pairmill.operators import vectors as V
from pairmill.operators.novelty import novelty_filter
from pairmill.schema import HANGUL, LATIN

ID = "doc_id"


def md5(seed, *cols):
    return f"md5(concat_ws('|', '{seed}', {', '.join(cols)}))"


def rk(seed, key, part=""):
    return f"row_number() OVER ({part} ORDER BY {md5(seed, key)}, {key})"


def hexint(e, n):
    return f"('0x'||substr({e},1,{n}))::BIGINT"


# ------------------------------------------------------------------ deduplication


@case("d01_dedupe_pair_normalized", f"""WITH {PAIRS} SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lower({norm('input')}), lower({norm('output')}) ORDER BY doc_id) rn FROM pairs) WHERE rn=1""")
def _(t):
    d = t.pairs.select(ID, "source", D.pair_key("input", "output").alias("k"))
    return D.first_wins(d, ["k"], [ID]).select(ID, "source")


@case("d02_dedupe_task_key", f"""WITH {PAIRS} SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY task_type, lang, input, output ORDER BY doc_id) rn FROM pairs) WHERE rn=1""")
def _(t):
    d = t.pairs.select(ID, D.task_key("task_type", "lang", "input", "output").alias("k"))
    return D.first_wins(d, ["k"], [ID]).select(ID)


@case("d03_dedupe_exact_tuple", f"""WITH {PAIRS}, s AS (SELECT doc_id, source, CASE WHEN length({strp('input')})<8 OR length({strp('output')})<1 THEN 'short' END AS st, {strp('input')} AS i, {strp('output')} AS o FROM pairs),
 r AS (SELECT *, row_number() OVER (PARTITION BY st IS NULL, i, o ORDER BY doc_id) rn FROM s)
 SELECT doc_id, coalesce(st, CASE WHEN rn=1 THEN 'kept' ELSE 'duplicate' END) AS status FROM r""")
def _(t):
    return D.exact_pairs(t.pairs, "input", "output", [ID], min_inp=8).select(ID, "status")


@case("d04_cross_pool_unique", """WITH u AS (SELECT md5(text) k, d.doc_id, 'high' AS pool, 0 rank FROM documents d JOIN labels USING (doc_id) WHERE quality=1
  UNION ALL SELECT md5(text), doc_id, 'short', 1 FROM documents WHERE n_chars<1500 UNION ALL SELECT md5(text), doc_id, 'rest', 2 FROM documents)
 SELECT doc_id, pool FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank, doc_id) rn FROM u) WHERE rn=1""")
def _(t):
    d = t.documents.select(ID, F.md5("text").alias("k"), "n_chars")
    high = d.join(t.labels.filter("quality = 1").select(ID), ID)
    pools = [("high", high), ("short", d.filter("n_chars < 1500")), ("rest", d)]
    return D.cross_pool_unique(pools, "k", [ID]).select(ID, "pool")


KW = f"list_transform(list_sort(list_transform(list_distinct({toks('text')}), lambda x: lpad((1000-length(x))::VARCHAR,4,'0')||x)), lambda y: substr(y,5))[1:14]"


def longest_first(c, n, script):
    k = F.array_sort(F.transform(F.array_distinct(X.words(c, script)), lambda x: F.concat(F.lpad((1000 - F.length(x)).cast("string"), 4, "0"), x)))
    return F.slice(F.transform(k, lambda y: F.substr(y, F.lit(5))), 1, n)


@case("d05_novelty_filter", f"""WITH RECURSIVE b AS (SELECT doc_id, CASE WHEN len({KW})=0 THEN ['rule'] ELSE {KW} END AS ks, lower({norm('text')}) AS tx, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
 ex AS (SELECT i, unnest(ks) AS k FROM b), ov AS (SELECT x.i AS u, y.i AS v, count(*) AS n FROM ex x JOIN ex y ON x.k=y.k AND x.i<y.i GROUP BY ALL),
 e AS (SELECT u, v FROM ov JOIN b p ON p.i=u JOIN b q ON q.i=v WHERE n::DOUBLE/(len(p.ks)+len(q.ks)-n)>=0.90 UNION SELECT p.i, q.i FROM b p JOIN b q ON p.tx=q.tx AND p.tx<>'' AND p.i<q.i),
 g AS (SELECT 1::BIGINT AS i, [1::BIGINT] AS kept UNION ALL SELECT g.i+1, CASE WHEN (SELECT count(*) FROM e WHERE e.v=g.i+1 AND list_contains(g.kept, e.u))>0 THEN kept ELSE list_append(kept, g.i+1) END FROM g WHERE g.i<(SELECT max(i) FROM b)),
 fin AS (SELECT unnest(kept) AS i FROM g WHERE i=(SELECT max(i) FROM b)) SELECT doc_id FROM b JOIN fin USING (i)""")
def _(t):
    d = t.documents.select(ID, longest_first("text", 14, LATIN).alias("kw"), F.col("text").alias("rule"))
    return novelty_filter(d, ID, "kw", "rule", prompt_tokens=X.words("rule", LATIN)).select(ID)


@case("d06_vector_merge", """WITH RECURSIVE e AS (SELECT vec_id, label::BIGINT AS layer, unnest([0, 1, 2]) AS copy, embedding FROM embeddings),
 s AS (SELECT copy * 10000000 + vec_id AS vid, layer, ['c' || copy, 'k' || (vec_id % 7)] AS kw, vec_id % 100 / 100.0::DOUBLE AS sc,
   list_transform(embedding, lambda x, k: x::DOUBLE + copy * 0.006::DOUBLE * sin((k - 1 + vec_id)::DOUBLE)) AS v FROM e),
 x AS (SELECT vid::BIGINT AS vid, layer, kw, sc, list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) AS v, row_number() OVER (PARTITION BY layer ORDER BY vid) AS i FROM s),
 g AS (SELECT DISTINCT layer, 0::BIGINT AS i, []::STRUCT(vid BIGINT, v DOUBLE[], kw VARCHAR[], sc DOUBLE, n BIGINT)[] AS r FROM x
  UNION ALL SELECT layer, i, CASE WHEN spot IS NULL OR c[spot] < 0.985 THEN list_append(r, {'vid': vid, 'v': v, 'kw': kw, 'sc': sc, 'n': 1::BIGINT})
    ELSE list_transform(r, lambda o, k: CASE WHEN k = spot THEN {'vid': o.vid, 'v': list_transform(u, lambda y: y / sqrt(list_dot_product(u, u))), 'kw': list_sort(list_distinct(list_concat(o.kw, kw))),
      'sc': greatest(o.sc, sc), 'n': o.n + 1} ELSE o END) END
  FROM (SELECT *, list_transform(r[spot].v, lambda y, k: 0.7::DOUBLE * y + 0.3::DOUBLE * v[k]) AS u
   FROM (SELECT *, list_position(c, list_max(c)) AS spot FROM (SELECT g.layer, g.i + 1 AS i, g.r, x.vid, x.v, x.kw, x.sc, list_transform(g.r, lambda o: list_dot_product(o.v, x.v)) AS c
    FROM g JOIN x ON x.layer = g.layer AND x.i = g.i + 1)))),
 f AS (SELECT layer, unnest(r) AS o FROM g WHERE i = (SELECT max(i) FROM x WHERE x.layer = g.layer))
 SELECT o.vid AS vid, 'skill' AS kind, layer, round(o.sc, 6) AS score, array_to_string(o.kw, ' ') AS keywords, o.n AS members, round(o.v[1], 6) AS v0 FROM f""")
def _(t):
    # Three nearby copies of every vector, so that merges happen; the shift depends on the copy.
    e = t.embeddings.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    shift = F.transform("embedding", lambda v, i: v.cast("double") + F.col("copy") * 0.006 * F.sin(i.cast("double") + F.col("vec_id")))
    d = e.select((F.col("copy") * 10_000_000 + F.col("vec_id")).alias("vid"), F.lit(" Skill ").alias("kind"), F.col("label").cast("long").alias("layer"),
                 (F.col("copy") * 10_000_000 + F.col("vec_id")).alias("step"), shift.alias("vector"),
                 F.array(F.concat(F.lit("K"), (F.col("vec_id") % 7).cast("string")), F.concat(F.lit("c"), F.col("copy").cast("string")), F.lit(" ")).alias("keywords"),
                 (F.col("vec_id") % 100 / 100.0).alias("score"))
    m = V.vector_merge(d, "vid", ["kind", "layer"], "step", "vector", "keywords", "score")
    return m.select("vid", "kind", "layer", r6(F.col("score")).alias("score"), F.array_join("keywords", " ").alias("keywords"), "members",
                    r6(F.get("vector", F.lit(0))).alias("v0"))


@case("d07_best_row_per_term", f"""WITH {QA}, s AS (SELECT term, p_partkey, output, CASE WHEN contains(lower(output), lower(term)) THEN 1 ELSE 0 END AS c, len(regexp_extract_all(output,'[가-힣]')) AS h, -abs(length(output)-80) AS l FROM qa)
 SELECT term, p_partkey, output FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY c DESC, h DESC, l DESC, p_partkey) rn FROM s) WHERE rn=1""")
def _(t):
    from pairmill.functions.score import term_answer_score

    return D.best_per_term(t.qa, "term", term_answer_score("term", "output"), "p_partkey").select("term", "p_partkey", "output")


# ------------------------------------------------------------------ caps and samples


@case("m01_seeded_shuffle", f"SELECT doc_id, {rk(42, 'doc_id')}::BIGINT AS place FROM documents")
def _(t):
    return S.seeded_shuffle(t.documents.select(ID), 42, ID).select(ID, F.col("place").cast("long").alias("place"))


@case("m02_per_source_cap", f"SELECT doc_id, source FROM (SELECT doc_id, source, {rk(42, 'doc_id', 'PARTITION BY source')} rn FROM documents) WHERE rn<=30")
def _(t):
    return S.take(t.documents.select(ID, "source"), 30, 42, ID, ["source"])


@case("m03_per_file_caps", """WITH a AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) r FROM documents),
 b AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) k FROM a WHERE r<=40 AND n_chars>500) SELECT doc_id, source FROM b WHERE k<=20""")
def _(t):
    scanned = S.take_first(t.documents.select(ID, "source", "n_chars"), 40, ID, ["source"])
    return S.take_first(scanned.filter("n_chars > 500"), 20, ID, ["source"]).select(ID, "source")


@case("m04_per_field_and_total_cap", """WITH a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) r FROM documents),
 b AS (SELECT doc_id, lang, row_number() OVER (ORDER BY lang, doc_id) g FROM a WHERE r<=150) SELECT doc_id, lang FROM b WHERE g<=400""")
def _(t):
    d = S.position_ranked(t.documents.select(ID, "lang"), ID, ["lang"], "_r", limit=F.lit(150)).drop("_r")
    block = F.concat_ws("|", "lang", F.lpad(F.floor(F.col(ID) / S.POSITION_BLOCK).cast("string"), 12, "0"))
    return S.ranked(d, [], ["lang", ID], block, "_g", limit=F.lit(400)).select(ID, "lang")


@case("m05_sample_n", f"SELECT doc_id FROM documents WHERE n_chars BETWEEN 200 AND 4000 ORDER BY {md5(42, 'doc_id')}, doc_id LIMIT 300")
def _(t):
    return S.take(t.documents.filter(F.col("n_chars").between(200, 4000)).select(ID), 300, 42, ID)


@case("m06_repeat_output_cap", f"""WITH {QA} SELECT p_partkey FROM (SELECT p_partkey, output, row_number() OVER (PARTITION BY output ORDER BY p_partkey) r FROM qa) WHERE r<=CASE WHEN length(output)<=25 THEN 5 ELSE 10 END""")
def _(t):
    return S.repeat_cap(t.qa.select("p_partkey", "output"), "output", "p_partkey", short_len=25).select("p_partkey")


@case("m07_prefix_cap", f"""WITH {QA}, k AS (SELECT p_partkey, array_to_string(regexp_extract_all(lower({norm('output')}), '[A-Za-z0-9가-힣]+')[1:4],' ') AS k FROM qa)
 SELECT p_partkey, k AS prefix FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p_partkey) r FROM k) WHERE r<=12""")
def _(t):
    d = t.qa.select("p_partkey", S.prefix_key(X.words(X.normalize_space("output"), HANGUL, 1)).alias("prefix"))
    return S.take_first(d, 12, "p_partkey", ["prefix"])


@case("m08_category_cap", f"""WITH {QA}, i AS (SELECT p_partkey, output, row_number() OVER (PARTITION BY output ORDER BY p_partkey) r FROM qa WHERE regexp_matches(input,'자기소개')),
 g AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) g FROM i WHERE r<=3) SELECT p_partkey FROM g WHERE g<=15 UNION ALL SELECT p_partkey FROM qa WHERE NOT regexp_matches(input,'자기소개')""")
def _(t):
    intro = F.col("input").rlike("자기소개")
    few = S.take_first(t.qa.filter(intro).select("p_partkey", "output"), 3, "p_partkey", ["output"]).select("p_partkey")
    return S.take_first(few, 15, "p_partkey").unionByName(t.qa.filter(~intro).select("p_partkey"))


@case("m09_source_dataset_cap", """SELECT event_id, bucket FROM (SELECT event_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY event_id) r FROM
 (SELECT event_id, coalesce(CASE WHEN event_type<>'view' THEN event_type END, 'file'||(user_id%3)::VARCHAR) AS bucket FROM events)) WHERE r<=120""")
def _(t):
    b = F.coalesce(F.when(F.col("event_type") != "view", F.col("event_type")), F.concat(F.lit("file"), (F.col("user_id") % 3).cast("string")))
    return S.take_first(t.events.select("event_id", b.alias("bucket")), 120, "event_id", ["bucket"])


@case("m10_reservoir", f"SELECT event_id FROM events WHERE value>10 ORDER BY {md5(31, 'event_id')}, event_id LIMIT 2000")
def _(t):
    return S.take(t.events.filter("value > 10").select("event_id"), 2000, 31, "event_id")


def wscore(seed, key, w):
    return f"-round(ln(({hexint(md5(seed, key), 13)}+0.5)/4503599627370496.0)/greatest({w},1e-6), 9)"


@case("m11_weighted_sample_without_replacement", f"SELECT c_custkey FROM customer ORDER BY {wscore(7, 'c_custkey', '(1+abs(c_acctbal)/1000.0)')}, c_custkey LIMIT 400")
def _(t):
    return S.weighted_take(t.customer.select("c_custkey", "c_acctbal"), 400, 1 + F.abs("c_acctbal") / 1000.0, 7, "c_custkey").select("c_custkey")


@case("m12_weighted_sample_with_replacement", f"""WITH {PAIRS}, w AS (SELECT doc_id, CASE tier WHEN 'high' THEN 2000000 WHEN 'mid' THEN 1200000 ELSE 700000 END AS w FROM pairs),
 c AS (SELECT doc_id, w, sum(w) OVER (ORDER BY {md5(5, 'doc_id')}, doc_id)::BIGINT AS hi FROM w), n AS (SELECT sum(w)::BIGINT AS total FROM w),
 d AS (SELECT i AS draw, floor(({hexint(md5(5, "'draw'", 'i'), 13)}+0.5)/4503599627370496.0*total)::BIGINT AS p FROM range(500) r(i), n)
 SELECT draw, doc_id FROM d JOIN c ON p>=hi-w AND p<hi""")
def _(t):
    w = F.when(F.col("tier") == "high", 2.0).when(F.col("tier") == "mid", 1.2).otherwise(0.7)
    return S.weighted_draws(t.pairs.select(ID, "tier"), 500, w, 5, ID).select("draw", ID)


@case("m13_balanced_by_group", f"""WITH r AS (SELECT doc_id, lang, {rk(9, 'doc_id', 'PARTITION BY lang')} r FROM documents), g AS (SELECT greatest(1, 300//count(DISTINCT lang)) per FROM documents)
 SELECT doc_id, lang FROM r, g ORDER BY r>per, {md5(9, 'doc_id')}, doc_id LIMIT 300""")
def _(t):
    return S.balanced(t.documents.select(ID, "lang"), 300, 9, ID, "lang")


@case("m14_group_quota", f"""WITH r AS (SELECT c_custkey, c_mktsegment AS seg, {rk(3, 'c_custkey', 'PARTITION BY c_mktsegment')} r, count(*) OVER (PARTITION BY c_mktsegment) n FROM customer),
 q AS (SELECT c_mktsegment AS seg, 100 + count(*)*(c_mktsegment LIKE 'A%' OR c_mktsegment LIKE 'B%')::INT AS q FROM customer GROUP BY c_mktsegment),
 d AS (SELECT DISTINCT seg, n, q FROM r JOIN q USING (seg) WHERE q>n), j AS (SELECT seg, n, unnest(range(1, q-n+1)) AS j FROM d)
 SELECT c_custkey, seg, false AS upsampled FROM r JOIN q USING (seg) WHERE r<=q
 UNION ALL SELECT c_custkey, r.seg, true FROM j JOIN r ON r.seg=j.seg AND r.r=1+({hexint(md5(3, 'j.seg', 'j.j'), 12)}) % j.n""")
def _(t):
    c = t.customer.select("c_custkey", F.col("c_mktsegment").alias("seg"))
    big = (F.substring("seg", 1, 1).isin("A", "B")).cast("int")
    lim = c.groupBy("seg").agg(F.count("*").alias("n")).select("seg", (100 + F.col("n") * big).alias("quota"))
    return S.quota(c, lim, 3, "c_custkey", "seg", upsample=True).select("c_custkey", "seg", F.col("_meta_upsampled").alias("upsampled"))


def pool(cond, seed):
    return f"(SELECT doc_id, {rk(seed, 'doc_id')} r, count(*) OVER () n FROM documents WHERE {cond})"


@case("m15_ratio_mix", f"""WITH a AS {pool("lang='en'", 42)}, b AS {pool("lang<>'en'", 42)}, k AS (SELECT (SELECT count(*) FROM a) na, (SELECT count(*) FROM b) nb),
 t AS (SELECT least(na+nb, greatest(300, nb)) AS total FROM k), g AS (SELECT total, floor(total*(7/10.0))::BIGINT AS ga FROM t)
 SELECT doc_id, 'a' AS component FROM a, g WHERE r<=ga UNION ALL SELECT doc_id, 'b' FROM b, g WHERE r<=total-ga""")
def _(t):
    d = t.documents.select(ID, "lang")
    m = S.ratio_mix(d.filter("lang = 'en'"), d.filter("lang <> 'en'"), (7, 3), 42, ID, floor_rows=300)
    return m.select(ID, F.col("_mix_source").alias("component"))


@case("m16_ratio_mix_fill", f"""WITH p AS (SELECT doc_id, 'en' AS component, 0 AS p, 320 AS want, r, n FROM {pool("lang='en'", 42)} UNION ALL SELECT doc_id, 'fr', 1, 240, r, n FROM {pool("lang='fr'", 42)} UNION ALL SELECT doc_id, 'de', 2, 140, r, n FROM {pool("lang='de'", 42)} UNION ALL SELECT doc_id, 'es', 3, 100, r, n FROM {pool("lang='es'", 42)}),
 s AS (SELECT *, CASE WHEN r<=want THEN 0 ELSE n-r+1 END AS rd FROM p), k AS (SELECT 800-count(*) AS rest FROM s WHERE rd=0), e AS (SELECT doc_id, component, row_number() OVER (ORDER BY rd, p) g FROM s WHERE rd>0)
 SELECT doc_id, component FROM s WHERE rd=0 UNION ALL SELECT doc_id, component FROM e, k WHERE g<=rest""")
def _(t):
    d = t.documents.select(ID, "lang")
    pools = [(g, d.filter(F.col("lang") == g)) for g in ("en", "fr", "de", "es")]
    return S.ratio_mix_fill(pools, (40, 30, 17.5, 12.5), 800, 42, ID).select(ID, F.col("_mix_source").alias("component"))


@case("m17_replay_ratio", f"""WITH b AS {pool("lang='es'", 42)}, k AS (SELECT (SELECT count(*) FROM documents WHERE lang='en') na, (SELECT count(*) FROM b) nb), w AS (SELECT round_even(na*0.25/0.75, 0)::BIGINT AS want, nb FROM k)
 SELECT doc_id, '' AS mix FROM documents WHERE lang='en' UNION ALL SELECT doc_id, 'logic_replay' FROM b, w, range(20) c(i) WHERE i*w.nb+r<=want""")
def _(t):
    d = t.documents.select(ID, "lang")
    m = S.replay_mix(d.filter("lang = 'en'"), d.filter("lang = 'es'"), 0.75, 0.25, 42, ID)
    return m.select(ID, F.col("_stage3b_mix").alias("mix"))


@case("m18_target_ratio_backfill", f"""WITH m AS (SELECT doc_id, row_number() OVER (ORDER BY {wscore(11, 'doc_id', '(1+n_chars/5000.0)')}, doc_id) r FROM documents WHERE lang='fr'), o AS {pool("lang<>'fr'", 11)},
 k AS (SELECT (SELECT count(*) FROM m) nm, (SELECT count(*) FROM o) AS n_o), a AS (SELECT *, least(round_even(400*0.84,0)::BIGINT, nm) AS tm FROM k), b AS (SELECT *, least(400-tm, n_o) AS t_o FROM a),
 c AS (SELECT *, least(nm-tm, 400-tm-t_o) AS am FROM b), f AS (SELECT tm+am AS tm, t_o+least(n_o-t_o, 400-tm-t_o-am) AS t_o FROM c)
 SELECT doc_id, 'main' AS side FROM m, f WHERE r<=tm UNION ALL SELECT doc_id, 'other' FROM o, f WHERE r<=t_o""")
def _(t):
    d = t.documents.select(ID, "lang", "n_chars")
    main, other = d.filter("lang = 'fr'"), d.filter("lang <> 'fr'")
    n_main, n_other = S.backfill_targets(400, 0.84, *S.counts(main, other))
    a = S.weighted_take(main, n_main, 1 + F.col("n_chars") / 5000.0, 11, ID).select(ID, F.lit("main").alias("side"))
    return a.unionByName(S.take(other, n_other, 11, ID).select(ID, F.lit("other").alias("side")))


@case("m19_row_weight_replication", f"""WITH {PAIRS}, w AS (SELECT doc_id, least(4, 1+(tier='high')::INT+(source IN ('src1','src2'))::INT+2*(contains(input,'the'))::INT) AS w FROM pairs)
 SELECT doc_id, w::BIGINT AS weight FROM w, range(4) c(i) WHERE i<w""")
def _(t):
    from pairmill.functions.score import row_weight

    w = row_weight([(F.col("tier") == "high", 1), (F.col("source").isin("src1", "src2"), 1), (F.col("input").contains("the"), 2)], 4)
    return S.replicate(t.pairs.select(ID, w.alias("weight")), F.col("weight")).select(ID, F.col("weight").cast("long").alias("weight"))


OFF = int(hashlib.md5(b"42").hexdigest()[:8], 16)


@case("m20_systematic_sample", f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id)-1 AS i, count(*) OVER () AS n FROM documents), s AS (SELECT *, greatest(1, n//130) AS step FROM r)
 SELECT doc_id FROM s WHERE i-({OFF}%step)>=0 AND (i-({OFF}%step))%step=0 AND (i-({OFF}%step))//step<130""")
def _(t):
    return S.systematic(t.documents.select(ID), 130, 42, ID, ID)


TOKENS = "(strlen(text)+45)"


@case("m21_token_budget_fill", f"""WITH RECURSIVE o AS (SELECT doc_id, {TOKENS} AS t, {rk(17, 'doc_id')} AS i FROM documents WHERE {TOKENS}<=12000),
 w AS (SELECT 0::BIGINT AS i, 0::BIGINT AS total, false AS took UNION ALL SELECT w.i+1, w.total+CASE WHEN w.total+o.t<=400000 THEN o.t ELSE 0 END, w.total+o.t<=400000 FROM w JOIN o ON o.i=w.i+1)
 SELECT doc_id, t::BIGINT AS tokens FROM w JOIN o ON o.i=w.i WHERE took""")
def _(t):
    d = t.documents.select(ID, (F.octet_length("text") + 45).cast("long").alias("tokens"))
    return S.fill_budget(d, "tokens", 400_000, 17, ID).select(ID, "tokens")



STAGE_POOLS = (
    ("stage1_base_lm", 30, "base"),
    ("stage2_curriculum", 15, "cur OR (base AND tokens >= 900) OR act"),
    ("stage3_distill", 10, "dis OR (ko AND tokens <= 1400 AND i <= 600 AND o <= 220 AND (base OR act)) OR (code AND tokens <= 900 AND o <= 140)"),
    ("stage4_instruction", 4, "(dis AND tokens <= 1100) OR (ko AND tokens <= 1200 AND o <= 240) OR (act AND tokens <= 1400)"),
)


def stages_sql():
    """Every stage walks its candidates in its own order, one row a step, as the sequential fill does."""
    parts, done = [], []
    for k, (name, share, pool) in enumerate(STAGE_POOLS):
        free = "".join(f" AND {ID} NOT IN (SELECT {ID} FROM s{j})" for j in range(k))
        parts.append(f"o{k} AS (SELECT {ID}, tokens AS t, {rk(f'42{k}', ID)} AS n FROM x WHERE ({pool}) AND tokens <= 40000{free})")
        parts.append(f"""w{k} AS (SELECT 0::BIGINT AS n, 0::BIGINT AS total, false AS took UNION ALL SELECT w.n + 1, w.total + CASE WHEN w.total + o.t <= b THEN o.t ELSE 0 END, w.total + o.t <= b
   FROM w{k} w JOIN o{k} o ON o.n = w.n + 1, (SELECT sum(tokens)::BIGINT * {share} // 100 AS b FROM x))""")
        parts.append(f"s{k} AS (SELECT {ID} FROM w{k} JOIN o{k} USING (n) WHERE took)")
        done.append(f"SELECT {ID}, '{name}' AS stage, tokens FROM s{k} JOIN x USING ({ID})")
    done.append(f"SELECT {ID}, 'over_length', tokens FROM x WHERE tokens > 40000 AND ({' OR '.join(f'({p})' for _, _, p in STAGE_POOLS)})")
    aug = {0: "cur", 1: "dis"}
    flags = ", ".join(f"{ID} % 5 = {k} AS {n}" for k, n in aug.items())
    return f"""WITH RECURSIVE {PAIRS}, x AS (SELECT {ID}, (strlen({FMT}) + 2)::BIGINT AS tokens, {flags}, {ID} % 5 > 1 AS base, task_type = 'korean' AS ko, task_type = 'code' AS code, length(input) AS i, length(output) AS o,
  contains(input, 'The') OR contains(output, 'Released') AS act FROM pairs), {', '.join(parts)} {' UNION ALL '.join(done)}"""


@case("m22_curriculum_stages", stages_sql())
def _(t):
    p = t.pairs
    rows = p.select(
        ID, F.when(F.col(ID) % 5 == 0, "extract_signatures").when(F.col(ID) % 5 == 1, "summary_extract").otherwise("").alias("augment_type"),
        X.approx_tokens("input", "output").alias("tokens"), F.col("task_type").alias("task"), F.length("input").alias("input_chars"),
        F.length("output").alias("output_chars"), (F.col("input").contains("The") | F.col("output").contains("Released")).alias("has_action"))
    total = int(rows.agg(F.sum("tokens")).first()[0])
    budgets = [("stage1_base_lm", total * 30 // 100), ("stage2_curriculum", total * 15 // 100), ("stage3_distill", total * 10 // 100), ("stage4_instruction", total * 4 // 100)]
    st = S.curriculum_stages(rows, budgets, 42, ID, ["extract_signatures"], ["summary_extract"], 40_000, rejected="over_length")
    return st.select(ID, "stage", "tokens")


@case("m23_clamped_split", f"""WITH r AS (SELECT event_id, {rk(42, 'event_id')} r, count(*) OVER () n FROM events) SELECT event_id, CASE WHEN r<=least(4096, greatest(1024, floor(n*0.02)::BIGINT)) THEN 'eval' ELSE 'train' END AS split FROM r""")
def _(t):
    return S.clamped_split(t.events.select("event_id"), 42, "event_id")


@case("m24_ratio_split", f"""WITH r AS (SELECT doc_id, {rk(42, 'doc_id')} r, count(*) OVER () n FROM documents) SELECT doc_id, CASE WHEN r<=floor(n*(1.0::DOUBLE-0.07::DOUBLE))::BIGINT THEN 'train' ELSE 'val' END AS split FROM r""")
def _(t):
    return S.ratio_split(t.documents.select(ID), 42, ID, 0.07)


@case("m25_stable_mod_split", f"SELECT doc_id, ({hexint('sha1(text)', 8)}) % 10 AS bucket FROM documents")
def _(t):
    return t.documents.select(ID, S.stable_mod("text", 10).alias("bucket"))


@case("m26_focus_sampling", f"""WITH s AS (SELECT user_id, count(*) AS c FROM events WHERE event_type='error' GROUP BY user_id), f AS (SELECT user_id, round_even(c*0.9,0)::BIGINT AS score FROM s), k AS (SELECT * FROM f WHERE score>0 ORDER BY score DESC, user_id LIMIT 50),
 h AS (SELECT user_id FROM k ORDER BY score DESC, user_id LIMIT 19), u AS (SELECT DISTINCT user_id FROM events),
 o AS (SELECT user_id FROM u WHERE user_id NOT IN (SELECT user_id FROM h) ORDER BY {md5(4, 'user_id')}, user_id LIMIT (SELECT 32-count(*) FROM h))
 SELECT user_id, true AS focus FROM h UNION ALL SELECT user_id, false FROM o""")
def _(t):
    e = t.events
    sc = e.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("score"))
    kept = S.decay_scores(sc, "user_id", "score", 0.9, 50)
    return S.focus_batch(e.select("user_id").distinct(), kept, 32, 0.6, 4, "user_id", "score").select("user_id", F.col("_focus").alias("focus"))


@case("m27_repeat_expand", "SELECT item_id, text FROM benchmark, range(6)")
def _(t):
    return S.repeat_pool(t.benchmark.select("item_id", "text"), 6)


@case("m28_curriculum_weight", f"""WITH {PAIRS}, m AS (SELECT doc_id, CASE tier WHEN 'high' THEN 2 WHEN 'mid' THEN 1 ELSE 0 END AS r, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS d FROM pairs)
 SELECT doc_id, {rnd('CASE r WHEN 2 THEN 1.2*(1.0+0.80*0.35) WHEN 1 THEN 1.1*(1.0+0.35*0.35) ELSE 1 END')} AS tier_w, {rnd('CASE d WHEN 2 THEN 1+0.9*0.35 WHEN 1 THEN 1+0.4*0.35 WHEN 0 THEN 1 ELSE 1+0.15*0.35 END')} AS domain_w,
 {rnd('CASE r WHEN 2 THEN 1.7 WHEN 1 THEN 1.25 ELSE 1 END*CASE d WHEN 0 THEN 1.0 WHEN 1 THEN 1.3 WHEN 2 THEN 1.6 ELSE 1.1 END')} AS sampler_w FROM m""")
def _(t):
    r = X.tier_rank("tier")
    d = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    return t.pairs.select(ID, r6(S.curriculum_weight(r, 0.35)).alias("tier_w"), r6(S.domain_weight(d, 0.35, 0.9, 0.4)).alias("domain_w"), r6(S.sampler_weight(r, d)).alias("sampler_w"))


@case("m29_shuffle_take_pools", f"""WITH d1 AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) f FROM documents), r AS (SELECT doc_id, lang, {rk(8, 'doc_id', 'PARTITION BY lang')} r FROM d1 WHERE f=1)
 SELECT doc_id, lang FROM r WHERE r<=CASE lang WHEN 'en' THEN 120 WHEN 'fr' THEN 60 WHEN 'de' THEN 30 ELSE 0 END""")
def _(t):
    u = D.first_wins(t.documents.select(ID, "lang", F.md5("text").alias("k")), ["k"], [ID]).drop("k")
    return S.pools_take(u, {"en": 120, "fr": 60, "de": 30}, 8, ID, "lang")
