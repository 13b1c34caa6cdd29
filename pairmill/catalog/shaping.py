"""Row shaping (P) and text metrics (T) over documents, conversations and pages."""

from pyspark.sql import functions as F

from pairmill.catalog.base import (BLANK, CHAT, LET, PAIRS, SYM, TOK, case, cln, cnt, div, jac, kterms, norm, r6, rnd,
                                   rtoks, stem, strp, toks)
from pairmill.functions import text as X
from pairmill.functions.counts import repeats
from pairmill.schema import LATIN

D = "doc_id"


def docs(t, *cols):
    return t.documents.select(D, *cols)


# ------------------------------------------------------------------ shaping


@case("p01_pick_first_non_empty", f"""SELECT event_id, coalesce(nullif({norm("json_extract_string(props,'$.input')")},''),
 nullif({norm("json_extract_string(props,'$.k')")},''), '') AS picked,
 coalesce(nullif({norm("CASE WHEN value>50 THEN '  ' || event_type END")},''), nullif({norm("props")},''), '') AS picked2
 FROM events""")
def _(t):
    e = t.events
    return e.select(
        "event_id",
        X.pick_first_non_empty([F.get_json_object("props", "$.input"), F.get_json_object("props", "$.k")]).alias("picked"),
        X.pick_first_non_empty([F.when(F.col("value") > 50, F.concat(F.lit("  "), "event_type")), "props"]).alias("picked2"),
    )


@case("p02_extract_pair", f"""SELECT p_partkey,
 CASE WHEN p_size%3=0 THEN {norm('p_name')} WHEN p_size%3=1 THEN {norm('p_brand')}||'란?' ELSE '' END AS input,
 CASE WHEN p_size%3=0 THEN {norm('p_type')} WHEN p_size%3=1 THEN {norm('p_type')} ELSE '' END AS output FROM part""")
def _(t):
    k = F.col("p_size") % 3
    raw = t.part.select(
        "p_partkey",
        F.when(k == 0, F.col("p_name")).alias("question"),
        F.when(k == 0, F.col("p_type")).alias("response"),
        F.when(k == 1, F.col("p_brand")).alias("term"),
        F.when(k == 1, F.col("p_type")).alias("answer"),
    )
    inp, out = X.extract_pair(raw.columns)
    return raw.select("p_partkey", inp.alias("input"), out.alias("output"))


@case("p03_normalize_space", f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def _(t):
    return docs(t, X.normalize_space("text").alias("norm"))


@case("p04_clean_text", f"SELECT doc_id, {cln('text')} AS cleaned, {strp(f'left({cln(chr(116)+chr(101)+chr(120)+chr(116))}, 200)')} AS cut FROM documents")
def _(t):
    return docs(t, X.clean_text("text").alias("cleaned"), X.clean_text("text", 200).alias("cut"))


@case("p05_canonical_row", f"""WITH {PAIRS} SELECT doc_id, {strp('input')} AS input, {strp('output')} AS output,
 CASE WHEN task_type='code' THEN 'code' WHEN task_type='korean' THEN 'korean' WHEN task_type='en' THEN 'english' ELSE task_type END AS task_type,
 CASE WHEN task_type='code' THEN 'code' WHEN task_type='korean' THEN 'ko' WHEN task_type='en' THEN 'english' ELSE 'other' END AS segment_tag,
 CASE WHEN task_type='code' THEN lang WHEN task_type='korean' THEN 'ko' WHEN task_type='en' THEN 'en' ELSE lang END AS language,
 'MIT' AS license, source AS source_dataset FROM pairs WHERE {strp('input')}<>'' AND {strp('output')}<>''""")
def _(t):
    from pairmill.operators.rows import canonical_rows

    rows = canonical_rows(t.pairs.withColumn("language", F.col("lang")))
    return rows.select(D, "input", "output", "task_type", "segment_tag", "language", "license", "source_dataset")


@case("p06_metadata_passthrough", f"""WITH {PAIRS} SELECT doc_id, nullif({norm('tier')},'') AS tier, nullif({norm('source')},'') AS source,
 nullif({norm('license')},'') AS license FROM pairs""")
def _(t):
    return t.pairs.select(D, *X.passthrough(["tier", "source", "license"]))


@case("p07_stable_row_id", """SELECT doc_id, 'doc_' || left(sha1(source || chr(10) || lang || chr(10) || text), 20) AS rid FROM documents""")
def _(t):
    return docs(t, X.stable_id("doc_", ["source", "lang", "text"]).alias("rid"))


FMT = "'### Instruction'||chr(10)||input||chr(10)||chr(10)||'### Response'||chr(10)||output||chr(10)"


@case("p08_format_example", f"""WITH {CHAT} SELECT conv_id, turn, {FMT} AS example,
 length('### Instruction'||chr(10)||input||chr(10)||chr(10)||'### Response'||chr(10))::BIGINT AS response_at FROM chat""")
def _(t):
    return t.chat.select("conv_id", "turn", X.format_example("input", "output").alias("example"),
                         X.response_offset("input").alias("response_at"))


@case("p09_tier_rank", f"""WITH {PAIRS} SELECT doc_id, CASE tier WHEN 'high' THEN 2 WHEN 'mid' THEN 1 ELSE 0 END::BIGINT AS rank,
 CASE tier WHEN 'high' THEN 'high' WHEN 'mid' THEN 'mid' ELSE 'base' END AS tier_name,
 CASE tier WHEN 'high' THEN 'hard' WHEN 'mid' THEN 'soft' ELSE 'observational' END AS hardness FROM pairs""")
def _(t):
    return t.pairs.select(D, X.tier_rank("tier").alias("rank"), X.rank_to_tier(X.tier_rank("tier")).alias("tier_name"),
                          X.tier_hardness("tier").alias("hardness"))


@case("p10_strip_known_prompt", f"""SELECT doc_id, {strp('text')} AS body FROM documents""")
def _(t):
    heads = ["Continue the source file.", "Summarize the text."]
    framed = t.documents.select(D, F.concat(F.element_at(F.array(*[F.lit(h) for h in heads]),
                                (F.col(D) % 2 + 1).cast("int")), F.lit("\n\n"), F.col("text")).alias("framed"))
    return framed.select(D, X.strip_known_prompt("framed", heads).alias("body"))


@case("p11_normalize_output", f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, {norm('CAST(l_quantity AS VARCHAR)')} AS q FROM lineitem),
 v AS (SELECT *, regexp_replace(q, '\\.0$', '') AS n FROM s)
 SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, CASE WHEN suffix(n,'.') THEN n ELSE n||'.' END AS fixed FROM v""")
def _(t):
    raw = F.concat(F.lit(" 정답은 "), F.col("l_quantity").cast("string"), F.lit("  confidence: 90% "))
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey",
                             X.normalize_output(raw, "정답은|답:|최종 답:", r"confidence:\s*\d+%?").alias("fixed"))


@case("p12_license_normalize", f"WITH {PAIRS} SELECT doc_id, lower({norm('license')}) AS license FROM pairs")
def _(t):
    return t.pairs.select(D, X.normalize_license("license").alias("license"))


@case("p13_charset_decode", "SELECT doc_id, replace(text, chr(13), '') AS decoded FROM documents")
def _(t):
    from pairmill.sources.binary import decode_column

    # Texts without adjacent accents are re-encoded in a one-byte code page, the rest stay UTF-8.
    one_byte = ~F.col("text").rlike("[À-ÿ]{2}|[À-Æ]") & ~F.col("text").rlike("[^\\x00-\\xff]")
    raw = t.documents.select(
        D,
        F.when(one_byte, F.encode("text", "iso-8859-1")).otherwise(F.encode("text", "utf-8")).alias("content"),
    )
    return decode_column(raw, "content", "decoded").select(D, "decoded")


@case("p14_group_key", f"""WITH {PAIRS} SELECT doc_id, coalesce(nullif(concat_ws('|', nullif(task_type,''), nullif(tier,''), nullif(lower({strp('license')}),'')),''),'default') AS gkey FROM pairs""")
def _(t):
    return t.pairs.select(D, X.group_key("task_type", "tier", "license").alias("gkey"))


N = norm("text")


@case("p15_trim_text", rf"""WITH n AS (SELECT doc_id, {N} AS s FROM documents),
 c AS (SELECT doc_id, s, trim(regexp_extract(left(s,220), '^(.*?[.!?])(?:\s|$)', 1)) AS cut FROM n)
 SELECT doc_id, CASE WHEN length(s)<=180 THEN s ELSE rtrim(left(s,177))||'...' END AS short,
 CASE WHEN length(cut)>=4 THEN cut ELSE trim(left(s,220)) END AS sentence FROM c""")
def _(t):
    return docs(t, X.trim_ellipsis("text", 180).alias("short"), X.first_sentence("text", 220).alias("sentence"))


@case("p16_question_simplify", rf"""WITH l AS (SELECT doc_id, {norm(f"coalesce(list_filter(string_split(text, chr(10)), lambda x: {norm('x')}<>'')[1],'')")} AS s FROM documents)
 SELECT doc_id, trim(regexp_replace(trim(regexp_replace(s, ', .*$', '')), '^(?:(?:the|que|la|of|and|in) +)+', '')) AS question FROM l""")
def _(t):
    return docs(t, X.simplify_question("text", ["the", "que", "la", "of", "and", "in"], ", ").alias("question"))


@case("p17_strip_tags", f"""SELECT page_id, replace(replace({norm("regexp_replace(html, '<[^>]+>', ' ', 'g')")}, ' ,', ','), ' .', '.') AS plain FROM pages""")
def _(t):
    return t.pages.select("page_id", X.strip_tags("html").alias("plain"))


# ------------------------------------------------------------------ metrics

S = cnt("text", SYM)
L = cnt("text", LET)


@case("t01_script_count", f"SELECT doc_id, {S} AS n FROM documents")
def _(t):
    return docs(t, X.script_count("text", LATIN).alias("n"))


@case("t02_script_ratio_letters", f"SELECT doc_id, {rnd(div(S, L))} AS r FROM documents")
def _(t):
    return docs(t, r6(X.script_ratio_letters("text", LATIN)).alias("r"))


@case("t03_script_ratio_chars", rf"""SELECT doc_id, {rnd(div(S, 'length(text)'))} AS r_all,
 {rnd(div(S, f"length(regexp_replace(text,'{BLANK}','','g'))"))} AS r_nonspace,
 {rnd(div(S, cnt('text', r'\p{L}\p{N}')))} AS r_alnum FROM documents""")
def _(t):
    return docs(t, r6(X.script_ratio_chars("text", LATIN)).alias("r_all"),
                r6(X.script_ratio_nonspace("text", LATIN)).alias("r_nonspace"),
                r6(X.script_ratio_alnum("text", LATIN)).alias("r_alnum"))


@case("t04_latin_ratio", f"SELECT doc_id, {rnd(div(cnt('text','A-Za-z'), L))} AS r FROM documents")
def _(t):
    return docs(t, r6(X.latin_ratio("text", LATIN)).alias("r"))


@case("t05_digit_ratio", rf"SELECT doc_id, {rnd(div(cnt('text', r'\p{Nd}'), 'length(text)', '1.0'))} AS r FROM documents")
def _(t):
    return docs(t, r6(X.digit_ratio("text")).alias("r"))


@case("t06_weird_ratio", rf"""SELECT doc_id, {rnd(div(cnt('w', r'\x00-\x08\x0b\x0c\x0e-\x1f'), 'length(w)', '1.0'))} AS r
 FROM (SELECT doc_id, replace(text, 'the', 'th'||chr(7)) AS w FROM documents)""")
def _(t):
    return docs(t, r6(X.weird_ratio(F.replace("text", F.lit("the"), F.lit("th\x07")))).alias("r"))


@case("t07_code_symbol_ratio", rf"SELECT page_id, {rnd(div(cnt('html', r'{}\[\]<>;=()#`'), 'length(html)'))} AS r FROM pages")
def _(t):
    return t.pages.select("page_id", r6(X.code_symbol_ratio("html")).alias("r"))


CLEAN = rf"len(regexp_extract_all(text, '{BLANK}|[{TOK}.,:;()/%+\-\x22\x27`]'))"


@case("t08_clean_char_ratio", f"SELECT doc_id, {rnd(div(CLEAN, 'length(text)'))} AS r FROM documents")
def _(t):
    return docs(t, r6(X.clean_char_ratio("text", LATIN)).alias("r"))


@case("t09_alnum_count", rf"SELECT doc_id, {cnt('text', r'\p{L}\p{N}')} AS n FROM documents")
def _(t):
    return docs(t, X.alnum_count("text").alias("n"))


@case("t10_token_diversity", f"""WITH k AS (SELECT doc_id, {toks('text')} AS k FROM documents)
 SELECT doc_id, {rnd(div('len(list_distinct(k))', 'len(k)', '1.0'))} AS diversity, len(k)>=14 AND len(list_distinct(k)) < 0.32*len(k) AS low FROM k""")
def _(t):
    k = X.words("text", LATIN)
    return docs(t, k.alias("k")).select(
        D, r6(X.token_diversity(F.col("k"))).alias("diversity"),
        ((F.size("k") >= 14) & (F.size(F.array_distinct("k")) < 0.32 * F.size("k"))).alias("low"))


EXPL = f"""k AS (SELECT doc_id, {toks('text', 1)} AS k FROM documents),
 c AS (SELECT doc_id, max(n) AS top, sum(n) AS total FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(k) AS w FROM k) GROUP BY ALL) GROUP BY doc_id)"""


@case("t11_top_token_share", f"""WITH {EXPL.replace(toks('text', 1), toks('text', 2))}
 SELECT k.doc_id, coalesce(c.top,0)::BIGINT AS top, {rnd('coalesce(c.top::DOUBLE/c.total,0)')} AS share,
 coalesce(c.total>=24 AND c.top::DOUBLE/c.total>0.30, false) AS noisy FROM k LEFT JOIN c USING (doc_id)""")
def _(t):
    d = docs(t, X.words("text", LATIN).alias("k")).select(D, F.size("k").alias("n"), X.top_count(F.col("k")).alias("top"), X.top_token_share(F.col("k")).alias("share"))
    return d.select(D, "top", r6(F.col("share")).alias("share"), ((F.col("n") >= 24) & (F.col("share") > 0.30)).alias("noisy"))


@case("t12_max_bigram_count", f"""WITH {EXPL}, g AS (SELECT doc_id, unnest(list_zip(k[1:len(k)-1], k[2:])) AS b FROM k WHERE len(k)>1),
 b AS (SELECT doc_id, max(n) AS big FROM (SELECT doc_id, b, count(*) n FROM g GROUP BY ALL) GROUP BY doc_id)
 SELECT k.doc_id, coalesce(b.big,0)::BIGINT AS big,
 coalesce(len(k.k)>=8 AND ((c.top>=4 AND c.top::DOUBLE/c.total>=0.24) OR b.big>=3), false) AS repetition_bad
 FROM k LEFT JOIN c USING (doc_id) LEFT JOIN b USING (doc_id)""")
def _(t):
    n, top, big = (F.get("r", F.lit(i)) for i in range(3))
    return docs(t, repeats(X.words("text", LATIN, 1)).alias("r")).select(D, big.alias("big"), X.repetition_rule(n, top, big).alias("repetition_bad"))


def runs(c: str, k: int, src: str = "documents", key: str = "doc_id") -> str:
    """Gaps and islands: longest run of one character (newlines never count)."""
    return f"""SELECT {key}, bool_or(n > {k}) AS hit FROM (SELECT {key}, grp, ch, count(*) AS n FROM (
      SELECT {key}, ch, i - row_number() OVER (PARTITION BY {key}, ch ORDER BY i) AS grp FROM (
        SELECT {key}, unnest(string_split({c}, '')) AS ch, generate_subscripts(string_split({c}, ''), 1) AS i FROM {src})
      WHERE ch <> chr(10)) GROUP BY ALL) GROUP BY {key}"""


@case("t13_char_run", f"""WITH r3 AS ({runs('text', 2)}), r8 AS ({runs('text', 8)})
 SELECT d.doc_id, coalesce(r3.hit,false) AS run2, coalesce(r8.hit,false) AS run8 FROM documents d LEFT JOIN r3 USING (doc_id) LEFT JOIN r8 USING (doc_id)""")
def _(t):
    return docs(t, X.char_run("text", 2).alias("run2"), X.char_run("text", 8).alias("run8"))


@case("t14_repeated_chunk", f"""WITH o AS (SELECT doc_id, regexp_replace(text,'[^{SYM}]','','g') AS s FROM documents),
 p AS (SELECT doc_id, s, unnest(range(1, length(s)-2)) AS i FROM o WHERE length(s)>=4),
 h AS (SELECT doc_id, bool_or((substr(s,i,2)=substr(s,i+2,2) AND length(substr(s,i+2,2))=2 AND substr(s,i,1)<>substr(s,i+1,1)) OR
   (substr(s,i,3)=substr(s,i+3,3) AND length(substr(s,i+3,3))=3 AND NOT (substr(s,i,1)=substr(s,i+1,1) AND substr(s,i,1)=substr(s,i+2,1)))) AS hit FROM p GROUP BY doc_id)
 SELECT o.doc_id, coalesce(h.hit,false) AS repeated FROM o LEFT JOIN h USING (doc_id)""")
def _(t):
    return docs(t, X.repeated_chunk("text", LATIN).alias("repeated"))


@case("t15_rare_symbol_ratio", f"""WITH ch AS (SELECT doc_id, unnest(regexp_extract_all(text,'[{SYM}]')) AS ch FROM documents),
 prof AS (SELECT ch FROM ch GROUP BY ch HAVING count(*)>=300)
 SELECT d.doc_id, {rnd('coalesce(x.r,0)')} AS rare FROM documents d LEFT JOIN (
  SELECT doc_id, avg(CASE WHEN prof.ch IS NULL THEN 1.0 ELSE 0.0 END) AS r FROM ch LEFT JOIN prof ON ch.ch=prof.ch GROUP BY doc_id) x USING (doc_id)""")
def _(t):
    from pairmill.operators.aggregate import symbol_profile
    from pairmill.operators.joins import rare_symbol_ratio

    prof = symbol_profile(t.documents, "text", LATIN).filter("n >= 300").select("ch")
    return rare_symbol_ratio(t.documents, D, "text", prof, LATIN).select(D, r6(F.col("rare")).alias("rare"))


@case("t16_approx_tokens", f"WITH {CHAT} SELECT conv_id, turn, (strlen({FMT})+2)::BIGINT AS tokens FROM chat")
def _(t):
    return t.chat.select("conv_id", "turn", X.approx_tokens("input", "output").alias("tokens"))


@case("t17_distinct_chars", """SELECT doc_id, len(list_distinct(string_split(text,'')))::BIGINT AS n FROM documents WHERE text<>''""")
def _(t):
    return t.documents.filter("text <> ''").select(D, X.distinct_chars("text").alias("n"))


@case("t18_symbol_noise", rf"""WITH r AS ({runs('text', 10)}) SELECT d.doc_id,
 contains(text, chr(65533)) OR coalesce(r.hit,false) OR len(regexp_extract_all(regexp_replace(text,'{BLANK}','','g'),
 '[^\p{{L}}\p{{M}}\p{{N}}_.,!?():;"\x27\-\[\]{{}}+/=*`~@#$%^&|\\]'))>=8 AS noisy FROM documents d LEFT JOIN r USING (doc_id)""")
def _(t):
    return docs(t, X.symbol_noise("text", LATIN).alias("noisy"))


@case("t19_question_runs", r"""WITH q AS (SELECT doc_id, replace(replace(text, 'th', '???'), ' ', '') AS s FROM documents),
 c AS (SELECT doc_id, s, length(s)-length(replace(s,'?','')) AS q FROM q)
 SELECT doc_id, (contains(s,'???') AND q>=greatest(8, length(s)//6)) OR (q>=12 AND q>=length(s)//5) AS noisy FROM c""")
def _(t):
    s = F.replace(F.replace("text", F.lit("th"), F.lit("???")), F.lit(" "), F.lit(""))
    return docs(t, X.question_noise(s).alias("noisy"))


SPLIT = rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])(?:{BLANK})+', '\1'||chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: {strp('x')}), lambda x: x<>'')"""


@case("t20_sentence_split", f"SELECT doc_id, len({SPLIT})::BIGINT AS n, array_to_string({SPLIT}, '|') AS joined FROM documents")
def _(t):
    return docs(t, X.sentences("text").alias("s")).select(D, F.size("s").cast("long").alias("n"), F.array_join("s", "|").alias("joined"))


@case("t21_token_sets", f"""WITH k AS (SELECT doc_id, {rtoks('text')} AS a, {kterms('text')} AS b FROM documents)
 SELECT doc_id, array_to_string(list_sort(a),' ') AS tokens, array_to_string(list_sort(b),' ') AS terms FROM k""")
def _(t):
    return docs(t, F.array_join(F.array_sort(X.retrieval_tokens("text", LATIN)), " ").alias("tokens"),
                F.array_join(F.array_sort(X.keyword_terms("text", LATIN)), " ").alias("terms"))


@case("t22_jaccard", f"WITH {CHAT}, k AS (SELECT conv_id, turn, {rtoks('input')} AS a, {rtoks('output')} AS b FROM chat) SELECT conv_id, turn, {rnd(jac('a','b'))} AS j FROM k")
def _(t):
    k = t.chat.select("conv_id", "turn", X.retrieval_tokens("input", LATIN).alias("a"), X.retrieval_tokens("output", LATIN).alias("b"))
    return k.select("conv_id", "turn", r6(X.jaccard(F.col("a"), F.col("b"))).alias("j"))


PLAIN = f"regexp_replace({{c}}, '[{SYM}]', 'e', 'g')"  # the checker measures edits in bytes


@case("t23_edit_similarity", f"""WITH {CHAT}, k AS (SELECT conv_id, turn, regexp_extract(lower({PLAIN.format(c='input')}), '^[^{TOK}]*([{TOK}]{{2,}})', 1) AS term, list_distinct({toks(PLAIN.format(c='output'))}) AS ts FROM chat)
 SELECT conv_id, turn, term, {rnd("CASE WHEN term='' OR len(ts)=0 THEN 0 ELSE greatest(0, list_max(list_transform(ts, lambda x: 1.0 - levenshtein(term,x)::DOUBLE/greatest(length(term),length(x),1)))) END")} AS sim FROM k""")
def _(t):
    c = t.chat.withColumns({"q": F.regexp_replace("input", f"[{SYM}]", "e"), "a": F.regexp_replace("output", f"[{SYM}]", "e")})
    c = c.withColumn("term", F.regexp_extract(F.lower("q"), f"^[^{LATIN.token}]*([{LATIN.token}]{{2,}})", 1))
    return c.select("conv_id", "turn", "term", r6(X.best_term_similarity("term", "a", LATIN)).alias("sim"))


@case("t24_final_consonant", """WITH s AS (SELECT doc_id, chr((44032 + doc_id % 11172)::INT) AS ch FROM documents)
 SELECT doc_id, ch, (doc_id % 11172) % 28 <> 0 AS closed, ch || CASE WHEN (doc_id % 11172) % 28 <> 0 THEN '은' ELSE '는' END AS topic FROM s""")
def _(t):
    code = 44032 + F.col(D) % 11172
    # UTF-8 bytes of the syllable block, built from the id.
    b = F.concat(F.lit("E"), F.hex(F.shiftright(code, 12).bitwiseAND(15)),
                 F.hex(F.lit(128).bitwiseOR(F.shiftright(code, 6).bitwiseAND(63))), F.hex(F.lit(128).bitwiseOR(code.bitwiseAND(63))))
    d = t.documents.select(D, F.decode(F.unhex(b), "utf-8").alias("ch"))
    return d.select(D, "ch", X.final_consonant("ch").alias("closed"), X.with_particle("ch", "은", "는").alias("topic"))
