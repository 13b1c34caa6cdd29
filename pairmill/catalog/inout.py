"""Scans and sources (S) and sinks (K): rows go out to the shared folder and are read back."""

from pyspark.sql import functions as F

from pairmill.catalog.base import CODE, PAIRS, QA, case, cln, cnt, div, norm, r6, rnd, strp
from pairmill.catalog.shaping import SYM, LET
from pairmill.functions import text as X
from pairmill.schema import LATIN
from pairmill.session import cut_lineage
from pairmill.sources import binary as B
from pairmill.sources import files as FL
from pairmill.sources import jsonl as J
from pairmill.sources import mounted as MT
from pairmill.sources import sinks as K

D = "doc_id"


def raw_lines(t):
    """documents as JSON lines with broken, blank and non-object lines mixed in by id."""
    half = F.floor(F.length("text") / 2).cast("int")
    obj = F.to_json(F.struct(F.col(D).cast("string").alias("id"), F.col("lang").alias("language"), "source", F.substr("text", F.lit(1), half).alias("input"),
                             F.when(F.col(D) % 3 > 0, F.substr("text", half + 1)).alias("output"), F.when(F.col(D) % 2 == 0, "high").alias("_meta_quality_tier")))
    line = F.when(F.col(D) % 11 == 0, F.substr(obj, F.lit(1), (F.length(obj) / 2).cast("int"))).when(F.col(D) % 13 == 0, F.concat(F.lit("["), F.col(D).cast("string"), F.lit("]"))).when(F.col(D) % 17 == 0, "   ").otherwise(obj)
    return t.documents.select("source", D, line.alias("value"))


def written(t):
    path = K.shared_folder(t.spark, "raw")
    raw_lines(t).drop(D).write.partitionBy("source").text(path)
    return path


STATUS = "CASE WHEN doc_id%11=0 THEN 'json_decode' WHEN doc_id%13=0 THEN 'not_dict' WHEN doc_id%17=0 THEN 'blank' ELSE 'ok' END"


@case("s01_jsonl_scan", f"SELECT source, {STATUS} AS status, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def _(t):
    s = J.jsonl_scan(t.spark, written(t))
    return s.groupBy(F.regexp_extract("path", r"source=([^/]+)/", 1).alias("source"), "status").agg(F.count("*").alias("n"))


@case("s01_jsonl_rows", f"SELECT doc_id::VARCHAR AS id, lang AS language, source, left(text,length(text)//2) AS input, CASE WHEN doc_id%3>0 THEN substr(text,length(text)//2+1) END AS output FROM documents WHERE {STATUS}='ok'")
def _(t):
    return J.jsonl_rows(t.spark, written(t)).select("id", "language", "source", "input", "output")


@case("s02_json_scan", "SELECT source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def _(t):
    # One pretty-printed array file per source and block of 500 ids, so file size is bounded.
    path = K.shared_folder(t.spark, "json")
    rec = F.to_json(F.struct("source", "n_chars"), {"pretty": "true"})
    g = t.documents.groupBy("source", F.floor(F.col(D) / 500).alias("part")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(rec), ",\n"), F.lit("\n]")).alias("value"))
    g.select("value", F.concat_ws("-", "source", "part").alias("file")).write.partitionBy("file").option("lineSep", "\n").text(path)
    d = J.json_scan(t.spark, path, "source string, n_chars long")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@case("s03_tsv_list_scan", f"SELECT p_partkey::BIGINT AS rank, {norm('p_name')} AS term, CASE p_size%4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE '' END AS grade FROM part WHERE p_size%7<>0 AND p_size%9<>0 AND p_partkey<=1500")
def _(t):
    path = K.shared_folder(t.spark, "vocab")
    g = F.when(F.col("p_size") % 4 == 0, "a").when(F.col("p_size") % 4 == 1, "B").when(F.col("p_size") % 4 == 2, " C").otherwise("z")
    full = F.concat_ws("\t", F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 9 == 0, "  ").otherwise(F.concat("p_name", F.lit(" "))), F.lit("n"), F.col("p_type"), g)
    short = F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name")
    rows = t.part.select(F.when(F.col("p_size") % 7 == 0, short).otherwise(full).alias("value"))
    rows.write.text(path)
    return J.vocabulary_scan(t.spark, path, 1500, header=False).select(F.col("rank").cast("long").alias("rank"), "term", "grade")


@case("s03_path_list_scan", "SELECT DISTINCT 'data/'||source||'.jsonl' AS path FROM documents")
def _(t):
    path = K.shared_folder(t.spark, "list")
    s = t.documents.select("source").distinct()
    text = F.explode(F.array(F.lit("# comment"), F.lit("path\tsize"), F.concat(F.lit("data\\"), "source", F.lit(".jsonl\t12\tx")), F.lit(" ")))
    s.select(text.alias("value")).write.text(path)
    return J.path_list_scan(t.spark, path)


@case("s04_cached_table_scan", "SELECT c_mktsegment AS subject, count(*)::BIGINT AS n FROM customer GROUP BY ALL")
def _(t):
    return J.table_scan(t.spark, f"{t.dir}/customer.parquet").groupBy(F.col("c_mktsegment").alias("subject")).agg(F.count("*").alias("n"))


@case("s05_hub_table_scan", f"""SELECT 'hf_mit_lang_'||left(sha1('public/qa'||chr(10)||'en'||chr(10)||{cln('q')}||chr(10)||{cln('a')}),20) AS id, {cln('q')} AS input, {cln('a')} AS output, 'public/qa' AS source_dataset
 FROM (SELECT CASE WHEN doc_id%2=0 THEN left(text,80) ELSE {cln('left(text,80)')}||chr(10)||chr(10)||'추가 정보:'||chr(10)||source END AS q, substr(text,81) AS a FROM documents) WHERE {cln('q')}<>'' AND {cln('a')}<>''""")
def _(t):
    d = t.documents.select(F.substring("text", 1, 80).alias("instruction"), F.when(F.col(D) % 2 == 1, F.col("source")).alias("input"), F.expr("substr(text, 81)").alias("output"))
    return J.adapt(d, "instruction_input_output", "public/qa", "en").select("id", "input", "output", "source_dataset")


@case("s06_archive_scan", f"""WITH {CODE}, m AS (SELECT 'own/'||replace(repo,'#','') AS repo, path, code FROM code WHERE NOT contains(path,'/config/'))
 SELECT repo, CASE WHEN regexp_matches(path,'\\.(py|ts|java|go)$') THEN 'code' WHEN regexp_matches(path,'\\.md$') THEN 'doc' ELSE 'other' END AS kind, count(*)::BIGINT AS members, sum(strlen(code))::BIGINT AS bytes FROM m GROUP BY ALL""")
def _(t):
    import io
    import zipfile

    import pandas as pd

    # Each task packs its own rows into one archive per repository; the archives are the input.
    c = t.code.select(F.concat(F.lit("own__"), F.replace("repo", F.lit("#"), F.lit("")), F.lit("__main.zip")).alias("archive"), "p_partkey", "path", "code")

    def pack(batches):
        for pdf in batches:
            for name, rows in pdf.groupby("archive"):
                buf = io.BytesIO()
                with zipfile.ZipFile(buf, "w") as z:
                    for k, p, s in zip(rows["p_partkey"], rows["path"], rows["code"]):
                        z.writestr(f"{k}/{p}", s)
                yield pd.DataFrame([("/" + name, buf.getvalue())], columns=["path", "content"])

    zips = c.mapInPandas(pack, "path string, content binary")
    m = B.archive_members(zips, skip=("config",))
    d = m.select(B.repo_of("path").alias("repo"), B.member_kind("member").alias("kind"), "size")
    return d.groupBy("repo", "kind").agg(F.count("*").alias("members"), F.sum("size").alias("bytes"))


@case("s06_archive_ranges", f"""WITH {CODE}, m AS (SELECT 'own/'||replace(repo,'#','') AS repo, path, CASE WHEN p_partkey%500=0 THEN repeat(code, 200) ELSE code END AS code FROM code WHERE NOT contains(path,'/config/'))
 SELECT repo, CASE WHEN regexp_matches(path,'\\.(py|ts|java|go)$') THEN 'code' WHEN regexp_matches(path,'\\.md$') THEN 'doc' ELSE 'other' END AS kind, CASE WHEN strlen(code)>20000 THEN 'oversize' ELSE 'ok' END AS status, count(*)::BIGINT AS members,
 sum(strlen(code))::BIGINT AS bytes, sum(CASE WHEN strlen(code)<=20000 THEN strlen(code) ELSE 0 END)::BIGINT AS read FROM m GROUP BY ALL""")
def _(t):
    code = F.when(F.col("p_partkey") % 500 == 0, F.repeat("code", F.lit(200))).otherwise(F.col("code"))
    c = t.code.select(F.concat(F.lit("own__"), F.replace("repo", F.lit("#"), F.lit(""))).alias("archive"), F.concat_ws("/", "p_partkey", "path").alias("member"), code.alias("code"))
    paths = cut_lineage(MT.write_archives(c, K.shared_folder(t.spark, "archives"), "archive", "member", "code"))
    m = MT.read_members(MT.archive_index(paths), 20_000, ("config",), 1 << 20)
    d = m.select(B.repo_of("path").alias("repo"), B.member_kind("member").alias("kind"), "status", "size", F.coalesce(F.octet_length("content"), F.lit(0)).alias("n"))
    return d.groupBy("repo", "kind", "status").agg(F.count("*").alias("members"), F.sum("size").alias("bytes"), F.sum("n").alias("read"))


@case("s07_file_discovery", """SELECT source, CASE WHEN source IN ('src1','src2') THEN 'excluded_by_path_token' END AS reason FROM documents GROUP BY source""")
def _(t):
    path = K.shared_folder(t.spark, "tree")
    d = t.documents.withColumn("dir", F.when(F.col("source").isin("src1", "src2"), F.concat(F.lit("smoke_"), "source")).otherwise(F.col("source")))
    d.select("dir", F.to_json(F.struct("doc_id", "lang")).alias("value")).write.partitionBy("dir").text(path)
    f = FL.discover(t.spark, path, "*.txt", ("smoke_",))
    return f.select(F.regexp_extract("rel", r"dir=(?:smoke_)?([^/]+)/", 1).alias("source"), "reason").distinct()


@case("s07_url_exclusion", """SELECT page_id FROM pages WHERE NOT (contains(lower(url),'/fr/') OR contains(lower(url),'page=2'))""")
def _(t):
    return t.pages.filter(~FL.excluded_path("url", ("/FR/", "page=2"))).select("page_id")


def okrows(bound):
    """The parsed rows among the first ``bound`` lines of every file."""
    return f"""f AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id//5000 ORDER BY doc_id) AS line FROM documents),
 ok AS (SELECT source||'-'||doc_id//5000 AS file, doc_id, lang, left(text,length(text)//2) AS i, CASE WHEN doc_id%3>0 THEN substr(text,length(text)//2+1) END AS o, doc_id%2=0 AS tier FROM f WHERE line<={bound} AND {STATUS}='ok')"""


def block_files(t, name):
    """One file for each source and 5,000 ids, lines in the order of their ids."""
    path = K.shared_folder(t.spark, name)
    d = raw_lines(t).withColumn("file", F.concat_ws("-", "source", F.floor(F.col(D) / 5000)))
    d.repartition("file").sortWithinPartitions("file", D).select("file", "value").write.partitionBy("file").text(path)
    return path


@case("s08_bounded_probe", f"""WITH {okrows(180)}, m AS (SELECT file, {norm('i')} AS i, {norm('o')} AS o, lang, tier FROM ok), b AS (SELECT *, i||chr(10)||o AS b FROM m)
 SELECT file, count(*)::BIGINT AS parsed, {rnd("avg((i<>'' AND o<>'')::INT)")} AS chat_ratio, {rnd('avg(tier::INT)')} AS tier_ratio, {rnd(f"avg((lang='fr' OR ({div(cnt('b', SYM), cnt('b', LET))})>=0.16)::INT)")} AS script_ratio FROM b GROUP BY file""")
def _(t):
    p = FL.probe(MT.head_scan(t.spark, block_files(t, "probe"), 180), 180, LATIN)
    return p.select(F.regexp_extract("path", r"file=([^/]+)/", 1).alias("file"), "parsed", *[r6(F.col(c)).alias(c) for c in ("chat_ratio", "tier_ratio", "script_ratio")])


@case("s08_probe_reason", f"""WITH {okrows(180)}, m AS (SELECT file, {norm('i')} AS i, {norm('o')} AS o, lang, tier FROM ok), b AS (SELECT *, i||chr(10)||o AS b FROM m),
 p AS (SELECT file, avg((i<>'' AND o<>'')::INT) AS chat, avg(tier::INT) AS tier, avg((lang='fr' OR ({div(cnt('b', SYM), cnt('b', LET))})>=0.16)::INT) AS script FROM b GROUP BY file)
 SELECT file, CASE WHEN chat<0.66 THEN 'probe_not_chat' WHEN script<0.30 THEN 'probe_not_ko' WHEN tier<=0 THEN 'probe_no_tier' END AS reason FROM p""")
def _(t):
    p = FL.probe(MT.head_scan(t.spark, block_files(t, "probe"), 180), 180, LATIN)
    return p.select(F.regexp_extract("path", r"file=([^/]+)/", 1).alias("file"), FL.probe_reason(0.66).alias("reason"))


@case("s08_probe_keys", f"""WITH {okrows(160)}, k AS (SELECT file, unnest(CASE WHEN o IS NULL AND NOT tier THEN ['id','language','source','input'] WHEN o IS NULL THEN ['id','language','source','input','_meta_quality_tier'] WHEN NOT tier THEN ['id','language','source','input','output'] ELSE ['id','language','source','input','output','_meta_quality_tier'] END) AS key FROM ok)
 SELECT file, key, count(*)::BIGINT AS n FROM k GROUP BY ALL""")
def _(t):
    k = FL.top_keys(MT.head_scan(t.spark, block_files(t, "keys"), 160), 160)
    return k.select(F.regexp_extract("path", r"file=([^/]+)/", 1).alias("file"), "key", "n")


@case("s09_source_spec", """SELECT doc_id, source, CASE source WHEN 'src5' THEN 0 WHEN 'src2' THEN 1 ELSE 2 END::BIGINT AS src_rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) rn FROM documents WHERE source IN ('src5','src2','src9'))
 WHERE rn<=CASE source WHEN 'src5' THEN 10 WHEN 'src2' THEN 25 ELSE 5 END""")
def _(t):
    from pairmill.operators.sample import position_ranked

    spec = J.source_table(t.spark, ["src5:10", "src2:25", "bad", "src9 : 5", ":7"])
    d = J.with_source(t.documents.select(D, "source"), spec, "source")
    limits = position_ranked(d, D, ["source", "src_rank", "row_limit"], "_r", limit=F.col("row_limit"))
    return limits.select(D, "source", F.col("src_rank").cast("long").alias("src_rank"))


# ------------------------------------------------------------------ sinks


@case("k01_jsonl_sink", f"WITH {PAIRS} SELECT doc_id, input, output, lang FROM pairs")
def _(t):
    path = K.shared_folder(t.spark, "out")
    K.write_jsonl(t.pairs.select(D, "input", "output", "lang"), path, ["lang"])
    return t.spark.read.schema("doc_id long, input string, output string, lang string").json(path)


@case("k02_manifest_sink", """SELECT (SELECT count(*) FROM documents)::BIGINT AS rows, (SELECT count(DISTINCT source) FROM documents)::BIGINT AS sources, 42::BIGINT AS seed""")
def _(t):
    path = K.shared_folder(t.spark, "manifest")
    d = t.documents
    K.write_manifest({"totals": d.agg(F.count("*").alias("rows")), "per_source": d.groupBy("source").agg(F.count("*").alias("n"))}, {"seed": 42, "probe_lines": 180}, path, t.spark)
    config, parts = K.read_manifest(t.spark, path)
    return parts["totals"].select("rows", F.lit(parts["per_source"].count()).cast("long").alias("sources"), F.lit(config["seed"]).cast("long").alias("seed"))


@case("k03_sources_tsv_sink", "SELECT source, count(*)::BIGINT AS scanned, count(*) FILTER (n_chars>1000)::BIGINT AS kept, 30::BIGINT AS cap FROM documents GROUP BY source")
def _(t):
    path = K.shared_folder(t.spark, "sources")
    K.write_tsv(t.documents.groupBy("source").agg(F.count("*").alias("scanned"), F.count_if(F.col("n_chars") > 1000).alias("kept"), F.lit(30).alias("cap")), path)
    return t.spark.read.csv(path, sep="\t", header=True, schema="source string, scanned long, kept long, cap long")


@case("k04_field_partition_sink", "SELECT source AS path, count(*)::BIGINT AS size_bytes, CASE WHEN avg(n_chars)>2400 THEN 'long' ELSE 'short' END AS field FROM documents GROUP BY source")
def _(t):
    path = K.shared_folder(t.spark, "fields")
    f = t.documents.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("size_bytes"), F.when(F.avg("n_chars") > 2400, "long").otherwise("short").alias("field"))
    K.write_field_lists(f, path)
    return t.spark.read.csv(path, sep="\t", header=True, schema="path string, size_bytes long, field string")


LOG = "SELECT event_type AS phase, CASE WHEN value>20 THEN 'ok' ELSE 'start' END AS status, count(*)::BIGINT AS n FROM events GROUP BY ALL"


def log_rows(t):
    return t.events.select("event_id", "ts", F.col("event_type").alias("phase"), F.when(F.col("value") > 20, "ok").otherwise("start").alias("status"), F.col("props").alias("payload"))


@case("k05_append_log", LOG)
def _(t):
    path = K.shared_folder(t.spark, "log")
    e = log_rows(t)
    K.append_log(e.filter("event_id % 2 = 0").drop("event_id"), path)
    K.append_log(e.filter("event_id % 2 = 1").drop("event_id"), path)
    return t.spark.read.schema("ts timestamp, phase string, status string, payload string").json(path).groupBy("phase", "status").agg(F.count("*").alias("n"))


@case("k05_log_stream", LOG)
def _(t):
    from pairmill.streaming.log_tail import log_stream, status_counts

    path = K.shared_folder(t.spark, "logs")
    K.append_log(log_rows(t).drop("event_id"), path)
    rows = K.shared_folder(t.spark, "logs-rows")
    q = log_stream(t.spark, path).writeStream.outputMode("append").format("parquet").option("path", rows).option("checkpointLocation", K.shared_folder(t.spark, "logs-state"))
    q.trigger(availableNow=True).start().awaitTermination()
    return status_counts(t.spark.read.parquet(rows))
