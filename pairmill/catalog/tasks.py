"""Extraction, augmentation and generation (X)."""

from itertools import permutations

from pyspark.sql import functions as F

from pairmill.catalog.base import BLANK, CHAT, CODE, PAIRS, QA, SYM, TOK, W1, W2, case, cln, cnt, jac, norm, r6, rnd, strp, words_in
from pairmill.catalog.filtering import action_sql, lang_sql, rx
from pairmill.catalog.sampling import md5, rk
from pairmill.catalog.shaping import SPLIT
from pairmill.functions import classify as C
from pairmill.functions import score as Q
from pairmill.functions import text as X
from pairmill.functions.lexicon import KOREAN
from pairmill.operators import augment as G
from pairmill.operators import generate as N
from pairmill.schema import HANGUL, LATIN

D = "doc_id"
P = "p_partkey"


def distinct_in_order(l):
    return f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"


def lines(c):
    return f"list_transform(string_split({c}, chr(10)), lambda x: {strp('x')})"


IMP_RE = r"^(?:import\s+.+|from\s+.+\s+import\s+.+|use\s+.+|#include\s+.+|(?:const|let|var)\s+\w+\s*=\s*require\(.+\)|require\(.+\)|using\s+.+)"
SIG_RE = (r"^(?:(?:def|class)\s+\w+|(?:export\s+)?(?:async\s+)?function\s+\w+|(?:export\s+)?class\s+\w+|(?:pub\s+)?(?:async\s+)?fn\s+\w+|func\s+\w+|"
          r"(?:public|private|protected|internal)\s+.+\(|(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\(.+\)\s*=>)")


def imports_sql(c):
    return f"list_filter({lines(c)}, lambda x: length(x)<=220 AND regexp_matches(x, '{IMP_RE}'))"


def sigs_sql(c):
    return (f"list_filter({lines(c)}, lambda x: length(x) BETWEEN 1 AND 240 AND NOT regexp_matches(x, '(?i)^(?:if |for |while |switch |catch |return )') "
            f"AND (regexp_matches(x, '{SIG_RE}') OR (contains(x,'(') AND contains(x,')') AND suffix(x,'{{'))))")


CODEX = f"{CODE}, l0 AS (SELECT *, {imports_sql('code')} AS im0, {sigs_sql('code')} AS sg0 FROM code), lx AS (SELECT *, {distinct_in_order('im0')}[1:14] AS im, {distinct_in_order('sg0')}[1:14] AS sg FROM l0)"


@case("x01_import_lines", f"WITH {CODEX} SELECT p_partkey, array_to_string(im, '|') AS imports FROM lx")
def _(t):
    return t.code.select(P, F.array_join(G.import_lines("code"), "|").alias("imports"))


@case("x02_signature_lines", f"WITH {CODEX} SELECT p_partkey, array_to_string(sg, '|') AS signatures FROM lx")
def _(t):
    return t.code.select(P, F.array_join(G.signature_lines("code"), "|").alias("signatures"))


def inl(words):
    return "(" + ",".join(f"'{w}'" for w in words) + ")"


def ranked_words(src, key, toks, n, cond):
    return f"""tk AS (SELECT {key}, unnest(k) AS t, generate_subscripts(k,1) AS i FROM (SELECT {key}, {toks} AS k FROM {src})),
 tc AS (SELECT {key}, t, count(*) AS c, min(i) AS f FROM tk WHERE {cond} GROUP BY ALL), tr AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY c DESC, f) AS r FROM tc),
 tw AS (SELECT {key}, list(t ORDER BY r) AS w FROM tr WHERE r<={n} GROUP BY {key})"""


WORD_KO = r"[A-Za-z가-힣_][A-Za-z0-9_+#.\-]{1,40}"
ID_COND = f"length(t)>=3 AND lower(t) NOT IN {inl(G.STOPWORDS + G.CODE_WORDS)} AND NOT regexp_matches(t,'^[0-9_]+$')"


@case("x03_identifiers", f"WITH {CODE}, {ranked_words('code', P, f'''regexp_extract_all(code, '{WORD_KO}')''', 12, ID_COND)} SELECT c.p_partkey, coalesce(array_to_string(w, ','),'') AS identifiers FROM code c LEFT JOIN tw USING (p_partkey)")
def _(t):
    return t.code.select(P, F.array_join(G.identifiers("code"), ",").alias("identifiers"))


WORD_LAT = "[A-Za-z" + SYM + r"_][A-Za-z0-9_+#.\-]{1,40}"
SWL = "list_distinct(regexp_extract_all(lower({c}), '[" + TOK + "_]{{2,}}'))"


@case("x04_keywords", f"""WITH {ranked_words('documents', D, f"regexp_extract_all(lower(text), '{WORD_LAT}')", 6, f"t NOT IN {inl(G.STOPWORDS)}")},
 lf AS (SELECT doc_id, list_sort(list_transform({SWL.format(c='text')}, lambda x: lpad((1000-length(x))::VARCHAR,4,'0')||x))[1:14] AS z FROM documents)
 SELECT d.doc_id, coalesce(array_to_string(w, ','),'') AS top, array_to_string(list_transform(z, lambda y: substr(y,5)), ',') AS longest FROM documents d LEFT JOIN tw USING (doc_id) JOIN lf USING (doc_id)""")
def _(t):
    return t.documents.select(D, F.array_join(G.keywords("text", 6, LATIN), ",").alias("top"), F.array_join(G.longest_keywords("text", n=14, script=LATIN), ",").alias("longest"))


def summary_sql(src, key, c):
    sents = SPLIT.replace("text", c)
    return f"""sq AS (SELECT {key}, list_filter({sents}, lambda x: length(x)>=25) AS s FROM {src}),
 sm AS (SELECT {key}, CASE WHEN len(s)=0 OR length(s[1])>340 THEN '' WHEN len(s)=1 OR length(s[1])+length(s[2])+1>340 THEN s[1] ELSE s[1]||' '||s[2] END AS summary FROM sq)"""


@case("x05_extractive_summary", f"WITH {summary_sql('documents', D, 'text')} SELECT doc_id, summary FROM sm")
def _(t):
    return t.documents.select(D, G.pick_summary("text").alias("summary"))


@case("x06_keyword_sentence", f"""WITH {ranked_words('documents', D, f"regexp_extract_all(lower(text), '{WORD_LAT}')", 1, f"t NOT IN {inl(G.STOPWORDS)}")},
 s AS (SELECT doc_id, {SPLIT} AS s FROM documents) SELECT doc_id, coalesce(list_filter(s, lambda x: length(x)>=20 AND contains(lower(x), w[1]))[1], '') AS sentence FROM s JOIN tw USING (doc_id)""")
def _(t):
    d = t.documents.select(D, "text", F.get(G.keywords("text", 1, LATIN), F.lit(0)).alias("k")).filter("k IS NOT NULL")
    return d.select(D, G.keyword_sentence("text", F.col("k")).alias("sentence"))


def heading_sql(c):
    h = f"list_transform(list_filter({lines(c)}, lambda x: starts_with(x,'#')), lambda y: {strp("regexp_replace(y, '^#+', '')")})"
    return f"coalesce(list_filter({h}, lambda z: length(z) BETWEEN 3 AND 120 AND NOT (length(z)-length(replace(z,'.',''))>1 AND length(z)>60))[1], '')"


@case("x07_heading", f"WITH m AS (SELECT doc_id, CASE WHEN doc_id%2=0 THEN '## '||replace(text, chr(10), chr(10)||'# ') ELSE text END AS b FROM documents) SELECT doc_id, {heading_sql('b')} AS heading FROM m")
def _(t):
    b = F.when(F.col(D) % 2 == 0, F.concat(F.lit("## "), F.replace("text", F.lit("\n"), F.lit("\n# ")))).otherwise(F.col("text"))
    return t.documents.select(D, G.heading(b).alias("heading"))


def kept(kind, key, share, seed=42):
    return f"(('0x'||substr({md5(seed, chr(39) + kind + chr(39), key)},1,13))::BIGINT+0.5)/4503599627370496.0 < {share}"


S = G.TASK_SHARE
ROLE = "CASE WHEN contains(lower(path),'/test') THEN 'test' WHEN contains(lower(path),'/components') OR contains(lower(fl),'react') THEN 'frontend' WHEN contains(lower(path),'/cli') OR contains(lower(path),'command') THEN 'cli' WHEN contains(lower(path),'/config') THEN 'config' WHEN contains(lower(path),'/docs') THEN 'docs' ELSE 'library' END"
BYPATH = r"CASE regexp_extract(path,'(\.[^./]+)$',1) WHEN '.py' THEN 'Python' WHEN '.ts' THEN 'TypeScript' WHEN '.java' THEN 'Java' WHEN '.go' THEN 'Go' ELSE 'Unknown' END"


@case("x08_augment_fanout", f"""WITH {CODE}, b AS (SELECT p_partkey, path, {strp('substr(code,81)')} AS r, {strp('left(code,80)')}||chr(10)||{strp('substr(code,81)')} AS fl FROM code),
 {ranked_words('b', P, f"regexp_extract_all(fl, '{WORD_KO}')", 12, ID_COND)}, l0 AS (SELECT *, {imports_sql('fl')} AS im0, {sigs_sql('fl')} AS sg0 FROM b),
 x AS (SELECT l0.*, {distinct_in_order('im0')}[1:14] AS im, {distinct_in_order('sg0')}[1:14] AS sg, w, {BYPATH} AS lg FROM l0 LEFT JOIN tw USING (p_partkey))
 SELECT p_partkey, 'continuation_rephrase_v2' AS aug_type, r AS output FROM x WHERE {kept('continuation_rephrase_v2', P, S['continuation_rephrase_v2'])}
 UNION ALL SELECT p_partkey, 'extract_imports_v2', array_to_string(im, chr(10)) FROM x WHERE len(im)>0 AND {kept('extract_imports_v2', P, S['extract_imports_v2'])}
 UNION ALL SELECT p_partkey, 'extract_signatures_v2', array_to_string(sg, chr(10)) FROM x WHERE len(sg)>0 AND {kept('extract_signatures_v2', P, S['extract_signatures_v2'])}
 UNION ALL SELECT p_partkey, 'identify_language_v1', lg FROM x WHERE lg<>'Unknown' AND {kept('identify_language_v1', P, S['identify_language_v1'])}
 UNION ALL SELECT p_partkey, 'classify_role_v1', {ROLE} FROM x WHERE {kept('classify_role_v1', P, S['classify_role_v1'])}
 UNION ALL SELECT p_partkey, 'extract_identifiers_v1', array_to_string(w[1:10], ', ') FROM x WHERE len(w)>=5 AND {kept('extract_identifiers_v1', P, S['extract_identifiers_v1'])}""")
def _(t):
    c = t.code.select(P, "path", F.substring("code", 1, 80).alias("input"), F.expr("substr(code, 81)").alias("output"))
    return G.code_tasks(c, P, "path", "input", "output", 42).select(P, "aug_type", "output")


@case("x08_document_fanout", f"""WITH b AS (SELECT doc_id, {strp(f"left({strp('text')}, 2600)")} AS fl FROM documents), f AS (SELECT * FROM b WHERE length(fl)>=180), {summary_sql('f', D, 'fl')},
 {ranked_words('f', D, f"regexp_extract_all(lower(fl), '{WORD_LAT}')", 6, f"t NOT IN {inl(G.STOPWORDS)}")}, x AS (SELECT f.doc_id, fl, summary, w, {SPLIT.replace('text', 'fl')} AS ss, {heading_sql('fl')} AS hd FROM f JOIN sm USING (doc_id) LEFT JOIN tw USING (doc_id)),
 y AS (SELECT *, coalesce(list_filter(ss, lambda s: length(s)>=20 AND contains(lower(s), w[1]))[1],'') AS st FROM x)
 SELECT doc_id, 'ko_summary_extract_v2' AS aug_type, summary AS output FROM y WHERE length(summary)>=40 UNION ALL SELECT doc_id, 'ko_keywords_extract_v2', array_to_string(w, ', ') FROM y WHERE len(w)>=4
 UNION ALL SELECT doc_id, 'ko_sentence_extract_v1', st FROM y WHERE length(st)>=20 AND {kept('ko_sentence_extract_v1', D, 0.65)} UNION ALL SELECT doc_id, 'ko_title_extract_v1', hd FROM y WHERE hd<>'' AND {kept('ko_title_extract_v1', D, 0.70)}""")
def _(t):
    return G.document_tasks(t.documents, D, "text", 42, LATIN).select(D, "aug_type", "output")


CUT = "least(greatest(floor(length(s)*0.55::DOUBLE)::INT, 140), length(s)-140)"


@case("x09_continuation_split", f"""WITH a AS (SELECT doc_id, {strp('text')} AS s FROM documents), c AS (SELECT doc_id, {strp(f'left(s, {CUT})')} AS l, {strp(f'substr(s, {CUT}+1)')} AS r FROM a WHERE length(s) BETWEEN 260 AND 60000),
 q AS (SELECT 'en' AS language, '{G.CONTINUE_CODE[0]}' AS p UNION ALL SELECT 'ko', '{G.KO_CONTINUE_CODE}') SELECT doc_id, language, p||chr(10)||chr(10)||l AS input, r AS output FROM c, q WHERE length(l)>=120 AND length(r)>=120""")
def _(t):
    return G.continuation_pairs(t.documents, [D], "text")


FENCE = "CASE WHEN p_partkey%2=0 THEN 'See:'||chr(10)||'```py'||chr(10)||code||'```' ELSE code END"


def snippet_sql(c):
    src = f"CASE WHEN regexp_extract({strp(c)}, '```[a-zA-Z0-9_+-]*\\n((?s:.){{8,1000}}?)```', 1)='' THEN {strp(c)} ELSE {strp(f"regexp_extract({strp(c)}, '```[a-zA-Z0-9_+-]*\\n((?s:.){{8,1000}}?)```', 1)")} END"
    ls = f"list_filter(list_transform(string_split({src}, chr(10)), lambda x: regexp_replace(x, '{BLANK}+$', '')), lambda y: {strp('y')}<>'')[1:28]"
    return f"regexp_replace(left({strp(f'array_to_string({ls}, chr(10))')}, 1200), '{BLANK}+$', '')"


@case("x10_code_snippet", f"""WITH {CODE}, a AS (SELECT p_partkey, {snippet_sql(FENCE)} AS sn FROM code), m AS (SELECT p_partkey, sn, lower(sn) AS s FROM a), g AS (SELECT p_partkey, sn, string_split({lang_sql()}, '|') AS g, {action_sql('s')} AS action FROM m WHERE sn<>'')
 SELECT p_partkey, 'lang' AS kind, 'The most likely language is '||g[1]||'. Evidence: 1) '||g[2]||'. 2) '||g[3]||'.' AS output, length(sn)::BIGINT AS n FROM g WHERE g[1]<>'Unknown'
 UNION ALL SELECT p_partkey, 'desc', 'This code mainly handles '||action||'. One potential risk is that '||CASE action {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in C.RISKS.items())} END||'.', length(sn)::BIGINT FROM g""")
def _(t):
    c = t.code.select(P, F.when(F.col(P) % 2 == 0, F.concat(F.lit("See:\n```py\n"), "code", F.lit("```"))).otherwise(F.col("code")).alias("code"))
    return G.snippet_rows(c, P, "code", "n").select(P, "kind", "output", "n")


LET6 = "CASE p_partkey%6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'E' ELSE 'none' END"


@case("x11_mcq_transform", f"""WITH m AS (SELECT p_partkey, {LET6} AS l, {W1} AS a, {W2} AS b, p_brand AS c, p_type AS d FROM part)
 SELECT p_partkey, CASE WHEN p_partkey%4=0 THEN '' ELSE '['||d||'] ' END || CASE l WHEN 'A' THEN 'A) '||a WHEN 'B' THEN 'B) '||b WHEN 'C' THEN 'C) '||c ELSE 'D) '||d END AS output FROM m WHERE l IN ('A','B','C','D')""")
def _(t):
    k = F.col(P) % 6
    letter = F.when(k == 0, "A").when(k == 1, "B").when(k == 2, "C").when(k == 3, "D").when(k == 4, "E").otherwise("none")
    w1, w2 = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    head = F.when(F.col(P) % 4 == 0, F.lit("Which one?")).otherwise(F.concat(F.lit("Question ("), "p_type", F.lit("): which one?")))
    q = F.concat(head, F.lit("\nA) "), w1, F.lit("\n B) "), w2, F.lit("\nC) "), "p_brand", F.lit("\nD) "), "p_type")
    d = t.part.select(P, G.mcq_content(q, F.concat(F.lit("Answer: "), letter)).alias("output"))
    return d.filter("output IS NOT NULL")


OPT = f"'A. '||{W1}||' B. '||{W2}||' C. '||p_brand||' D. '||p_type"


@case("x12_mcq_templates", f"""WITH m AS (SELECT p_partkey, CASE p_partkey%5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'X' END AS l, ' 분야: '||p_brand||'. 문제: part '||p_name||' '||{OPT} AS q, {W1} AS a, {W2} AS b, p_brand AS c, p_type AS d FROM part),
 n AS (SELECT *, CASE l WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d END AS t FROM m WHERE l<>'X')
 SELECT p_partkey, 'letter' AS kind, '다음 객관식 문제를 풀고 선택지 문자만 답하라.'||q AS input, l AS output FROM n UNION ALL SELECT p_partkey, 'text', '다음 객관식 문제를 풀고 정답 내용을 짧게 답하라.'||q, t FROM n UNION ALL SELECT p_partkey, 'both', '다음 객관식 문제를 풀어 한 줄로 답하라.'||q, l||'. '||t FROM n""")
def _(t):
    k = F.col(P) % 5
    letter = F.when(k == 0, "a").when(k == 1, "B").when(k == 2, "C").when(k == 3, " D").otherwise("X")
    opts = [("A", F.split_part("p_name", F.lit(" "), F.lit(1))), ("B", F.split_part("p_name", F.lit(" "), F.lit(2))), ("C", F.col("p_brand")), ("D", F.col("p_type"))]
    return G.mcq_rows(t.part, [P], F.concat(F.lit("part "), "p_name"), opts, letter, F.col("p_brand"))


@case("x13_boolean_templates", f"""WITH {CHAT}, m AS (SELECT conv_id, turn, rtrim(left({norm('output')}, 700)) AS a, {norm('input')} AS b, CASE turn%4 WHEN 1 THEN 1 WHEN 3 THEN 0 END AS y FROM chat)
 SELECT conv_id, turn, 'short' AS kind, '{G.BOOLEAN_TEXTS['boolq'][0]} 문단: '||a||' 질문: '||b AS input, CASE y WHEN 1 THEN '예' ELSE '아니오' END AS output FROM m WHERE a<>'' AND b<>'' AND y IS NOT NULL
 UNION ALL SELECT conv_id, turn, 'explained', '{G.BOOLEAN_TEXTS['boolq'][1]} 문단: '||a||' 질문: '||b, CASE y WHEN 1 THEN '{G.BOOLEAN_TEXTS['boolq'][4]}' ELSE '{G.BOOLEAN_TEXTS['boolq'][5]}' END FROM m WHERE a<>'' AND b<>'' AND y IS NOT NULL""")
def _(t):
    y = F.when(F.col("turn") % 4 == 1, 1).when(F.col("turn") % 4 == 3, 0)
    return G.boolean_rows(t.chat, ["conv_id", "turn"], F.col("output"), F.col("input"), y)


@case("x14_tool_rows", f"""WITH {QA}, m AS (SELECT q.p_partkey, q.p_partkey%8 AS k, input AS i, output AS o, {W1} AS w1, (p_size+q.p_partkey%90)::VARCHAR AS v, p_size||' + '||(q.p_partkey%90) AS e FROM qa q JOIN part p ON p.p_partkey=q.p_partkey),
 r AS (SELECT *, CASE k WHEN 0 THEN 'definition' WHEN 2 THEN 'calculator' ELSE 'direct' END AS kind FROM m), c AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY p_partkey) AS rn FROM r),
 f AS (SELECT * FROM c WHERE rn<=CASE kind WHEN 'definition' THEN 100 WHEN 'calculator' THEN 90 ELSE 700 END), a AS (SELECT *, CASE kind WHEN 'definition' THEN 'ACTION search '||lower(w1) ELSE 'ACTION calculator '||e END AS act FROM f)
 SELECT p_partkey, kind, 'action' AS step, '{G.TOOL_HEAD}'||i||'{G.TOOL_ASK}' AS input, act AS output FROM a WHERE kind<>'direct'
 UNION ALL SELECT p_partkey, kind, 'final', '{G.TOOL_HEAD}'||i||CASE kind WHEN 'direct' THEN '{G.TOOL_ASK}' ELSE ' '||act||' OBSERVATION '||CASE kind WHEN 'definition' THEN regexp_extract(o,'^(.*?[.])(?: |$)',1) ELSE v END||'{G.TOOL_FINAL}' END,
  'FINAL '||CASE kind WHEN 'calculator' THEN v||'입니다.' ELSE o END FROM a""")
def _(t):
    return G.tool_rows(t.qa, P, "input", "output", {"definition": 100, "calculator": 90, "direct": 700})


def num_sql(v):
    return f"CASE WHEN abs({v}-round({v}))<1e-9 THEN round({v})::BIGINT::VARCHAR ELSE regexp_replace(printf('%.6f', {v}), '\\.?0+$', '') END"


@case("x15_calc_rows", f"""WITH m AS (SELECT p_partkey, p_size::DOUBLE AS a, (1+p_partkey%7)::DOUBLE AS b, p_partkey%4 AS k FROM part), v AS (SELECT *, CASE k WHEN 0 THEN a+b WHEN 1 THEN a-b WHEN 2 THEN a*b ELSE a/b END AS v, (600+p_partkey%50)::DOUBLE*b/a AS rv FROM m)
 SELECT p_partkey, a::BIGINT||' '||['+','-','*','/'][k+1]||' '||b::BIGINT AS expr, {num_sql('v')} AS value, (600+p_partkey%50)||'*'||b::BIGINT||'/'||a::BIGINT AS ratio_expr, {num_sql('rv')}||'g' AS ratio_value FROM v""")
def _(t):
    k, a, b = F.col(P) % 4, F.col("p_size").cast("string"), (1 + F.col(P) % 7).cast("string")
    op = F.when(k == 0, "+").when(k == 1, "-").when(k == 2, "*").otherwise("/")
    e, v = G.binary_expression(F.concat(F.lit("계산해줘 "), a, F.lit(" "), op, F.lit(" "), b, F.lit(" 는?")))
    n = (600 + F.col(P) % 50).cast("string")
    q = F.concat(F.lit("설탕과 밀가루 비율이 "), b, F.lit(":"), a, F.lit("이다. 밀가루가 "), n, F.lit("g이면 설탕은?"))
    r = G.ratio_question(q)
    return t.part.select(P, e.alias("expr"), G.number_text(v).alias("value"), r.alias("r")).select(P, "expr", "value", F.col("r.expr").alias("ratio_expr"), F.concat(G.number_text(F.col("r.value")), F.col("r.unit")).alias("ratio_value"))


@case("x16_definition_term", f"""SELECT p_partkey, CASE p_partkey%8 WHEN 0 THEN lower({W1}) WHEN 1 THEN lower({W2}) WHEN 2 THEN '계산해줘' WHEN 3 THEN '설명하라' WHEN 4 THEN lower({W1}) WHEN 5 THEN CASE WHEN length(p_brand)=7 THEN 'brand' ELSE substr(p_brand,7) END WHEN 6 THEN '간단히' ELSE '방법' END AS term FROM part""")
def _(t):
    return t.qa.select(P, Q.definition_term("input").alias("term"))


@case("x17_anchor_answer", f"""WITH {QA}, m AS (SELECT p_partkey, term, CASE WHEN length(trim(regexp_extract(left(output,180),'^(.*?[.!?])(?: |$)',1)))>=4 THEN trim(regexp_extract(left(output,180),'^(.*?[.!?])(?: |$)',1)) ELSE trim(left(output,180)) END AS a FROM qa)
 SELECT p_partkey, CASE WHEN contains(lower(a), lower(term)) THEN a ELSE term||'는 '||a END AS anchored FROM m""")
def _(t):
    return t.qa.select(P, G.anchored_answer("term", "output").alias("anchored"))


def logic_frame(t):
    k = F.col("o_orderkey") % 6
    cat = F.element_at(F.array(*[F.lit(c) for c in (*G.ANSWER_ONLY, "sequence", "syllogism")]), (k + 1).cast("int"))
    return t.orders.select("o_orderkey", cat.alias("category"), F.concat(F.lit("\n  문제 "), F.col("o_custkey").cast("string"), F.lit(" 번. 답변 형식: 숫자\n둘째 줄")).alias("input"),
                           F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("정답만"), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.lit("이유: 값 "), F.col("o_custkey").cast("string"), F.lit(" 비교\n답: x"))).alias("output"),
                           F.col("o_custkey").cast("string").alias("final_answer"))


SUFFIX = G.ANSWER_ONLY_SUFFIX.replace("\n", "'||chr(10)||'")


@case("x18_answer_only", f"""SELECT o_orderkey, '문제 '||o_custkey||' 번.'||'{SUFFIX}' AS input, '정답: '||o_custkey AS output FROM orders WHERE o_orderkey%6<4""")
def _(t):
    return G.answer_only(logic_frame(t)).select("o_orderkey", "input", "output")


@case("x19_tutor_rewrite", f"""SELECT o_orderkey, '힌트: 핵심 조건을 한 줄씩 정리하라.'||chr(10)||'재시도: '||CASE WHEN o_orderkey%4=0 THEN '{G.DEFAULT_REASON}' ELSE '값 '||o_custkey||' 비교' END||chr(10)||'정답: '||o_custkey||chr(10)||'요약: 핵심 조건을 따라가면 답은 '||o_custkey||'입니다.' AS output FROM orders""")
def _(t):
    return logic_frame(t).select("o_orderkey", G.tutor_output("output", "final_answer").alias("output"))


MUT = {n: x.replace("\n", "'||chr(10)||'") for n, x in G.MUTATORS}


@case("x20_prompt_mutators", f"""WITH m AS (SELECT conv_id*1000+turn AS k, {strp('text')} AS s, {SPLIT} AS ps, list_filter(string_split({norm('text')}, ' '), lambda x: x<>'') AS w FROM conversations WHERE role='user'),
 r AS (SELECT *, rtrim(array_to_string(list_transform(w, lambda x, i: x || CASE WHEN i<len(w) AND (('0x'||substr(md5(concat_ws('|','5',k,i-1)),1,13))::BIGINT+0.5)/4503599627370496.0<0.18 THEN chr(10) ELSE ' ' END), '')) AS ws FROM m),
 v AS (SELECT k, 'identity' AS mutator, s AS text FROM r UNION ALL SELECT k, 'reorder', CASE WHEN len(ps)>=2 THEN array_to_string(list_reverse(ps),' ') ELSE s END FROM r UNION ALL SELECT k, 'whitespace', CASE WHEN len(w)<=3 THEN s ELSE ws END FROM r
  {' '.join(f"UNION ALL SELECT k, '{n}', s||'{x}' FROM r" for n, x in MUT.items())}) SELECT * FROM v""")
def _(t):
    c = t.conversations.filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")
    return G.mutate_prompts(c, "k", "text", 5)


@case("x21_spec_rows", f"""WITH {PAIRS}, m AS (SELECT doc_id, {norm('input')} AS q, {norm('output')} AS a, tier FROM pairs), f AS (SELECT *, {cnt("q||chr(10)||a", SYM)} AS n, {cnt("q||chr(10)||a", 'A-Za-z')} AS l FROM m WHERE length(q)>=8 AND length(a)>=8),
 s AS (SELECT * FROM f ORDER BY {md5(42, 'doc_id')}, doc_id LIMIT 400) SELECT 'spec_'||lpad(doc_id::VARCHAR,7,'0') AS id, CASE tier WHEN 'high' THEN 'hard' WHEN 'mid' THEN 'soft' ELSE 'observational' END AS tier, q AS prompt, a AS target,
 CASE tier WHEN 'high' THEN 2.6 WHEN 'mid' THEN 3.1 ELSE 3.8 END::DOUBLE AS max_token_nll, CASE WHEN n>=4 AND n>=floor(0.2*greatest(l,1)) THEN 'fr' WHEN l>0 THEN 'en' ELSE 'other' END AS language FROM s""")
def _(t):
    s = G.spec_rows(t.pairs, D, "input", "output", "tier", 400, 42, script=LATIN)
    return s.select("id", "tier", "prompt", "target", F.col("verifier.max_token_nll").cast("double").alias("max_token_nll"), F.element_at("meta", "language").alias("language"))


@case("x22_distill_rows", """SELECT 'patch_'||doc_id AS patch_id, 'Apply verified rules when relevant and answer the user query.'||chr(10)||chr(10)||'Verified rule:'||chr(10)||text||chr(10)||chr(10)||'User query:'||chr(10)||source AS input, lang AS output, (n_chars%40)::BIGINT AS uses
 FROM documents ORDER BY n_chars%40 DESC, doc_id DESC LIMIT 60""")
def _(t):
    r = t.documents.select(F.concat(F.lit("patch_"), F.col(D).cast("string")).alias("patch_id"), F.col("text").alias("rule_text"), F.col("source").alias("prompt"), F.col("lang").alias("target"),
                           (F.col("n_chars") % 40).alias("uses"), F.col(D).alias("created_step"))
    return G.distill_rows(r, 60).select("patch_id", "input", "output", "uses")


def pick_sql(words, tag, keys, seed=42):
    return f"[{','.join(chr(39) + w + chr(39) for w in words)}][(('0x'||substr({md5(seed, chr(39) + tag + chr(39), keys)},1,8))::BIGINT % {len(words)})+1]"


@case("x23_phrase_variants", f"""WITH {QA}, m AS (SELECT p_partkey, draw, {norm(pick_sql(G.ASK_BEFORE, 'a', 'p_partkey, draw') + '||input||' + pick_sql(G.ASK_AFTER, 'b', 'p_partkey, draw'))} AS input, {norm(pick_sql(G.SAY_BEFORE, 'c', 'p_partkey, draw') + '||output')} AS output FROM qa, range(3) r(draw))
 SELECT p_partkey, draw, input, output FROM (SELECT *, row_number() OVER (PARTITION BY lower(input), lower(output) ORDER BY p_partkey, draw) rn FROM m) WHERE rn=1""")
def _(t):
    return G.phrase_variants(t.qa, P, "input", "output", 3, 42).select(P, F.col("draw").cast("long").alias("draw"), "input", "output")


def ko_terms(t):
    code = 44032 + F.col(P) % 11172
    b = F.concat(F.lit("E"), F.hex(F.shiftright(code, 12).bitwiseAND(15)), F.hex(F.lit(128).bitwiseOR(F.shiftright(code, 6).bitwiseAND(63))), F.hex(F.lit(128).bitwiseOR(code.bitwiseAND(63))))
    return t.part.select(F.concat("p_brand", F.decode(F.unhex(b), "utf-8")).alias("term"), F.concat("p_name", F.lit("  "), "p_type").alias("definition"))


@case("x24_term_templates", """WITH m AS (SELECT p_brand||chr((44032+p_partkey%11172)::INT) AS t, (p_partkey%11172)%28<>0 AS c, p_name||' '||p_type AS d FROM part)
 SELECT t AS term, unnest([t||CASE WHEN c THEN '이란' ELSE '란' END, t||CASE WHEN c THEN '이' ELSE '가' END||' 뭐야?', t||' 정의', t||' 설명해줘', '한국어로 '||t||CASE WHEN c THEN '이란' ELSE '란' END, t||CASE WHEN c THEN '을' ELSE '를' END||' 한 줄로 설명해줘', t||CASE WHEN c THEN '이' ELSE '가' END||' 무엇인지 알려줘']) AS input, d AS output FROM m""")
def _(t):
    return G.term_templates(ko_terms(t), "term", "definition")


@case("x25_suite_rows", f"""WITH {CHAT}, e AS (SELECT conv_id*1000+turn AS k, input, output FROM chat), r AS (SELECT input, output FROM e ORDER BY {md5(42, 'k')}, k LIMIT 50),
 s AS (SELECT text AS input, 'answer '||item_id AS output FROM benchmark, range(4) WHERE item_id%2=0) SELECT part, input, output FROM (SELECT 'suite' AS part, * FROM s UNION ALL SELECT 'replay', * FROM r)""")
def _(t):
    suite = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("prompt"))
    canonical = t.benchmark.filter("item_id % 2 = 0").select(F.col("item_id").alias("id"), F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("answer"))
    replay = t.chat.withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    return G.suite_rows(suite, canonical, "id", 4, replay, 50, 42, "k").select("part", "input", "output")


@case("x25_suite_leaks", f"""WITH {PAIRS}, ev AS (SELECT DISTINCT lower({norm('input')}) AS k FROM pairs WHERE doc_id%10=0) SELECT doc_id FROM pairs WHERE doc_id%10<>0 AND lower({norm('input')}) IN (SELECT k FROM ev)""")
def _(t):
    p = t.pairs
    return G.leaked_prompts(p.filter(F.col(D) % 10 != 0), p.filter(F.col(D) % 10 == 0)).select(D)


# ------------------------------------------------------------------ generators, one row per order

K = "o_orderkey"


def below(name, n, seed=42):
    return f"(('0x'||substr({md5(seed, chr(39) + name + chr(39), K)},1,8))::BIGINT % {n})"


def between(name, lo, hi):
    return f"({below(name, hi - lo + 1)}+{lo})"


def chance(name, seed=42):
    return f"((('0x'||substr({md5(seed, chr(39) + name + chr(39), K)},1,13))::BIGINT+0.5)/4503599627370496.0)"


def choice(name, items):
    return f"[{','.join(chr(39) + str(x) + chr(39) for x in items)}][{below(name, len(items))}+1]"


def gen(name):
    def run(t):
        return N.generate(t.orders.select(K), K, name, 42).select(K, "input", "output", "final_answer")

    return run


def gen_sql(prompt, reason, answer, src):
    return f"SELECT {K}, {prompt} AS input, '이유: '||{reason}||chr(10)||'답: '||{answer} AS output, {answer} AS final_answer FROM {src}"


SQLGEN = {}
SQLGEN["compare_smallest"] = gen_sql("a||'는 '||b||'보다 크고, '||b||'는 '||c||'보다 크다. 가장 작은 것은 누구인가?'", "a||' > '||b||' > '||c||' 이므로 가장 작은 것은 '||c||'입니다.'", "c",
                                     f"(SELECT {K}, p[1] AS a, p[2] AS b, p[3] AS c FROM (SELECT {K}, {choice('names', [''.join(p) for p in permutations('ABCD', 3)])} AS p FROM orders))")
SQLGEN["probability"] = gen_sql("'주머니에 빨간 공 '||r||'개와 파란 공 '||b||'개가 있다. 하나를 무작위로 뽑을 때 파란 공일 확률은?'", "'전체 '||(r+b)||'개 중 파란 공이 '||b||'개이므로 확률은 '||b||'/'||(r+b)||'이고 기약분수는 '||a||'입니다.'", "a",
                                f"(SELECT *, CASE WHEN (r+b)//gcd(b,r+b)=1 THEN (b//gcd(b,r+b))::VARCHAR ELSE (b//gcd(b,r+b))||'/'||((r+b)//gcd(b,r+b)) END AS a FROM (SELECT {K}, {between('red', 1, 6)} AS r, {between('blue', 1, 6)} AS b FROM orders))")
SQLGEN["sequence"] = gen_sql("'수열 '||x0||', '||x1||', '||x2||', '||x3||', '||x4||', '||x5||', ? 다음 수를 규칙 기반으로 설명하고 답하라.'", "'규칙이 번갈아 ×'||m||', +'||d||' 이므로 다음 수는 '||(x5+d)||'입니다.'", "(x5+d)::VARCHAR",
                             f"(SELECT *, x4*m AS x5 FROM (SELECT *, x3+d AS x4 FROM (SELECT *, x2*m AS x3 FROM (SELECT *, x1+d AS x2 FROM (SELECT *, x0*m AS x1 FROM (SELECT {K}, {between('start', 2, 12)} AS x0, [2,3][{below('mul', 2)}+1]::BIGINT AS m, {between('add', 1, 5)} AS d FROM orders))))))")
SQLGEN["syllogism"] = gen_sql("CASE WHEN y THEN '모든 '||a||'는 '||b||'다. 모든 '||b||'는 '||c||'다. 그러면 모든 '||a||'는 '||c||'인가?' ELSE '모든 '||a||'는 '||b||'다. 어떤 '||b||'는 '||c||'다. 그러면 어떤 '||a||'는 '||c||'인가?' END",
                              "CASE WHEN y THEN a||'가 모두 '||b||'에 포함되고 '||b||'가 모두 '||c||'에 포함되므로 예입니다.' ELSE b||' 일부가 '||c||'라는 정보만으로 그 대상이 '||a||'인지 알 수 없어 보장할 수 없습니다.' END", "CASE WHEN y THEN '예' ELSE '알 수 없음' END",
                              f"(SELECT {K}, p[1] AS a, p[2] AS b, p[3] AS c, y FROM (SELECT {K}, {choice('terms', [''.join(p) for p in permutations('ABCDE', 3)])} AS p, {below('mode', 2)}=0 AS y FROM orders))")
SQLGEN["sentence_relation_yesno"] = gen_sql("p||' 위 두 문장을 함께 보면 '''||q||'''가 참인가? 예/아니오로 답하라.'", "r", "a",
                                            f"(SELECT o.{K}, v.* FROM (SELECT {K}, {below('item', 5)} AS i FROM orders) o JOIN (VALUES {','.join('(' + str(i) + ',' + ','.join(chr(39) + x + chr(39) for x in r) + ')' for i, r in enumerate(N.RELATIONS))}) v(i, p, q, a, r) ON o.i=v.i)")
SQLGEN["clock_drift"] = gen_sql("'시계가 하루에 '||p||'분 느려진다. 정확한 시간에 맞춘 뒤 '||d||'일이 지나면 몇 분 차이인가?'", "p||'분씩 '||d||'일이면 '||(p*d)||'분입니다.'", "(p*d)||'분'", f"(SELECT {K}, {between('per', 1, 18)} AS p, {between('days', 2, 30)} AS d FROM orders)")
SQLGEN["ratio"] = gen_sql("l||'과 '||r||'의 비율이 '||a||':'||b||'이다. '||r||'이 '||(b*m)||'개라면 '||l||'은 몇 개인가?'", "r||' '||(b*m)||'개는 비율 '||b||'에 해당하므로 한 단위는 '||m||'이고, '||l||'은 '||a||'단위라서 '||(a*m)||'개이다.'", "(a*m)::VARCHAR",
                          f"(SELECT {K}, {between('ra', 1, 9)} AS a, {between('rb', 1, 9)} AS b, {between('unit', 5, 80)} AS m, {choice('left', ['설탕', '연필', '빨간 구슬', '남학생'])} AS l, {choice('right', ['밀가루', '공책', '파란 구슬', '여학생'])} AS r FROM orders)")
SQLGEN["linear_add_then_mul"] = gen_sql("'어떤 수에 '||o||'을 더하고 '||m||'를 곱하면 '||((x+o)*m)||'가 된다. 그 수를 구하라.'", "((x+o)*m)||'÷'||m||'='||(x+o)||', '||(x+o)||'-'||o||'='||x", "x::VARCHAR", f"(SELECT {K}, {between('x', 2, 60)} AS x, {between('off', 2, 12)} AS o, {between('lmul', 2, 9)} AS m FROM orders)")
SQLGEN["latex_fraction"] = gen_sql("'분수 '||n||'/'||m||'를 LaTeX 수식으로 써라.'", "'분자와 분모를 차례로 쓴다.'", r"'\frac{'||n||'}{'||m||'}'", f"(SELECT {K}, {between('num', 1, 20)} AS n, {between('den', 2, 20)} AS m FROM orders)")
SQLGEN["latex_equation"] = gen_sql("CASE WHEN t THEN '1부터 '||u||'까지의 합을 나타내는 시그마 수식을 LaTeX로 써라.' ELSE '일차방정식 '||a||'x + '||b||' = '||c||'를 LaTeX로 써라.' END", "'식을 그대로 옮긴다.'", r"CASE WHEN t THEN '\sum_{i=1}^{'||u||'} i' ELSE a||'x+'||b||'='||c END",
                                   f"(SELECT {K}, {below('form', 2)}=0 AS t, {between('upper', 3, 12)} AS u, {between('ca', 2, 9)} AS a, {between('cb', 1, 12)} AS b, {between('cc', 20, 120)} AS c FROM orders)")

for _n, _k in (("x26_gen_compare", "compare_smallest"), ("x27_gen_probability", "probability"), ("x28_gen_sequence", "sequence"), ("x29_gen_syllogism", "syllogism"), ("x30_gen_relation", "sentence_relation_yesno"),
               ("x32_gen_clock", "clock_drift"), ("x32_gen_ratio", "ratio"), ("x32_gen_linear", "linear_add_then_mul"), ("x32_gen_latex_fraction", "latex_fraction"), ("x32_gen_latex_equation", "latex_equation")):
    case(_n, SQLGEN[_k])(gen(_k))


def slot(bits, at, lo, hi):
    return f"((('0x'||substr({bits},{at},8))::BIGINT % {hi - lo + 1})+{lo})"


def dig(x, i):
    return f"({x}//{10 ** i}%10)"


def operands_sql(i, kind):
    """The pair at the drawn place, cell by cell; each cell's lists are unfolded from the last one on."""
    cells = N.operand_cells(kind)
    sizes = N.cell_sizes(cells)
    arms, before = [], 0
    for cell, size in zip(cells, sizes, strict=True):
        parts, below = [], 1
        for f, t in reversed(cell):
            parts.append(f"[{','.join(f'({x * f},{y * f})' for x, y in t)}][(r-{before})//{below}%{len(t)}+1]")
            below *= len(t)
        a, b = (" + ".join(p + f"[{j}]" for p in parts) for j in (1, 2))
        arms.append((before + size, a, b))
        before += size
    pick = lambda j: "CASE " + " ".join(f"WHEN r<{hi} THEN {x[j]}" for hi, *x in arms) + " END"
    return f"SELECT {K}, ({pick(0)})::BIGINT AS a, ({pick(1)})::BIGINT AS b FROM (SELECT {K}, ('0x'||substr({md5(42, chr(39) + kind + chr(39), K)},1,15))::BIGINT % {sum(sizes)} AS r FROM orders WHERE {K}%13={i})"


def arith_sql(i, kind):
    n = int(kind[-1]) if kind[:3] in ("add", "sub") else 0
    src = operands_sql(i, kind)
    if kind == "addsub_d1":
        src = f"SELECT {K}, CASE WHEN pl THEN a ELSE greatest(a,b) END AS a, CASE WHEN pl THEN b ELSE least(a,b) END AS b, CASE WHEN pl THEN '+' ELSE '-' END AS op FROM (SELECT *, {below('op', 2)}=0 AS pl FROM ({src}))"
        ans, ask, share = "CASE WHEN op='+' THEN a+b ELSE a-b END", "CASE WHEN op='+' THEN a||'와 '||b||'를 더하면?' ELSE a||'에서 '||b||'를 빼면?' END", 0
    else:
        op = {"add": "+", "sub": "-", "mul": "*", "div": "/"}[kind[:3]]
        src = f"SELECT *, '{op}' AS op FROM ({src})"
        ans = {"+": "a+b", "-": "a-b", "*": "a*b", "/": "a//b"}[op]
        ask = {"+": "a||'에 '||b||'를 더하면?'", "-": "a||'에서 '||b||'를 빼면?'", "*": "a||' 곱하기 '||b||'는?'" if kind == "mul_1x1" else "a||'에 '||b||'를 곱하면?'", "/": "a||'을 '||b||'로 나누면?'"}[op]
        share = {"mul_1x1": 0, "mul_2x1": 0.75}.get(kind, 0.60 if op == "*" else 0.50 if op == "/" else 1 if n >= 4 else 0.35)
    place = ["일의 자리", "십의 자리", "백의 자리", "천의 자리"]
    steps = "''"
    if kind.startswith("add_carry"):
        parts = []
        for j in range(n):
            da, db = dig("a", j), dig("b", j)
            cy = f"(a%{10 ** j}+b%{10 ** j}>={10 ** j})::INT" if j else "0"
            tot = f"({da}+{db}+{cy})"
            parts.append(f"'{place[j]}: '||{da}||'+'||{db}||CASE WHEN {cy}>0 THEN '+올림 1' ELSE '' END||'='||{tot}||CASE WHEN {tot}>=10 THEN ', '||({tot}%10)||'를 쓰고 1 올림' ELSE ', '||{tot}||'를 쓴다' END")
        steps = "||' '||".join(parts) + f"||CASE WHEN a+b>={10 ** n} THEN ' 남은 올림 1을 앞에 붙인다' ELSE '' END"
    elif kind.startswith("sub_borrow"):
        parts = []
        for j in range(n):
            da, db = dig("a", j), dig("b", j)
            ow = f"(a%{10 ** j}<b%{10 ** j})::INT" if j else "0"
            cur = f"({da}-{ow})"
            parts.append(f"'{place[j]}: '||{da}||CASE WHEN {ow}>0 THEN '-빌림 1' ELSE '' END||CASE WHEN {cur}<{db} THEN '가 '||{db}||'보다 작아 10을 빌려 '||({cur}+10)||'-'||{db}||'='||({cur}+10-{db}) ELSE '-'||{db}||'='||({cur}-{db}) END")
        steps = "||' '||".join(parts)
    elif kind == "mul_2x1":
        steps = "'부분곱1: '||a||'×'||b||'='||(a*b)"
    elif kind.startswith("mul_2x2"):
        steps = "'부분곱1: '||a||'×'||(b%10)||'='||(a*(b%10))||' 부분곱2: '||a||'×'||(b//10)||'×10='||(a*(b//10)*10)||' 합: '||(a*(b%10))||' + '||(a*(b//10)*10)||' = '||(a*b)"
    elif kind.startswith("div"):
        steps = "a||'÷'||b||'='||(a//b)||' 검산: '||b||'×'||(a//b)||'='||a"
    worked = {0: "false", 1: "true"}.get(share, f"{chance('steps')}<{share}")
    return f"""SELECT {K}, CASE st WHEN 0 THEN a||op||b||'='||chr(10)||e WHEN 1 THEN '다음을 계산하라. '||a||op||b||chr(10)||e ELSE ask||chr(10)||e END AS input, CASE WHEN wk THEN '풀이: '||steps||chr(10)||tail ELSE tail END AS output, ans::VARCHAR AS final_answer,
  '{kind}' AS category, '{kind}_'||['symbolic','calc','word'][st+1] AS prompt_style, CASE WHEN wk THEN '1' ELSE '0' END AS has_cot FROM (SELECT *, CASE WHEN wk THEN '{N.LAST_STEPS}' ELSE {choice('end', [N.LAST_PLAIN, N.LAST_FINAL])} END AS e,
   CASE md WHEN 'final' THEN '최종답: '||ans WHEN 'answer' THEN '정답: '||ans ELSE ans::VARCHAR END AS tail FROM (SELECT *, CASE WHEN wk THEN CASE WHEN u<0.45 THEN 'final' WHEN u<0.65 THEN 'answer' ELSE 'bare' END ELSE CASE WHEN u<0.55 THEN 'bare' WHEN u<0.85 THEN 'final' ELSE 'answer' END END AS md
    FROM (SELECT {K}, a, b, op, {ans} AS ans, {ask} AS ask, {steps} AS steps, {worked} AS wk, {chance('mode')} AS u, {below('style', 3)} AS st FROM ({src}))))"""


@case("x31_gen_arithmetic", " UNION ALL ".join(arith_sql(i, k) for i, k in enumerate(N.ARITHMETIC_KINDS)))
def _(t):
    kind = F.element_at(F.array(*[F.lit(k) for k in N.ARITHMETIC_KINDS]), (F.col(K) % len(N.ARITHMETIC_KINDS) + 1).cast("int"))
    return N.arithmetic(t.orders.select(K), K, kind, 42)


def mix_sql():
    acc, arms = 0.0, []
    for name, w in N.MIX_WEIGHTS:
        lo, acc = round(acc, 6), round(acc + w, 6)
        cond = f"u<={acc}" if not arms else (f"u>{lo}" if name == N.MIX_WEIGHTS[-1][0] else f"u>{lo} AND u<={acc}")
        arms.append(f"SELECT g.{K}, g.input, g.output, '{name}' AS category FROM ({SQLGEN[name]}) g JOIN w USING ({K}) WHERE {cond}")
    return f"WITH w AS (SELECT {K}, {chance('kind')} AS u FROM orders) " + " UNION ALL ".join(arms)


@case("x33_generator_mix", mix_sql())
def _(t):
    return N.generator_mix(t.orders.select(K), K, 42).select(K, "input", "output", "category")


@case("x34_tokenizer_corpus", f"""WITH {CHAT}, m AS (SELECT conv_id*1000+turn AS k, {norm('input')} AS q, {norm('output')} AS a FROM chat), l AS (SELECT k, 0 AS part, q AS line FROM m UNION ALL SELECT k, 1, a FROM m UNION ALL SELECT k, 2, '### Instruction '||q||' ### Response '||a FROM m WHERE q<>'' AND a<>'')
 SELECT k, part::BIGINT AS part, rtrim(left(line,1600)) AS line FROM l WHERE length(line)>=2""")
def _(t):
    c = t.chat.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "input", "output")
    return G.tokenizer_lines(c, "k", "input", "output").withColumn("part", F.col("part").cast("long"))


@case("x35_premise_closure", f"""WITH RECURSIVE e AS (SELECT DISTINCT p_brand, lower({W1}) AS a, lower({W2}) AS b FROM part WHERE {W1}<>{W2}), n AS (SELECT p_brand, a FROM e UNION SELECT p_brand, b FROM e),
 r AS (SELECT p_brand, a, a AS b FROM n UNION SELECT r.p_brand, r.a, e.b FROM r JOIN e ON e.p_brand=r.p_brand AND e.a=r.b) SELECT DISTINCT p_brand, a, b FROM r""")
def _(t):
    w1, w2 = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    said = F.when(F.col(P) % 2 == 0, F.concat(F.lit("Note. All "), w1, F.lit(" are "), w2, F.lit(". Done."))).otherwise(F.concat(F.lit("모든 "), w1, F.lit("는 "), w2, F.lit("이다.")))
    facts = G.subset_facts(t.part.select("p_brand", said.alias("text")), "p_brand", "text")
    low = facts.select("p_brand", F.lower("a").alias("a"), F.lower("b").alias("b")).distinct()
    return G.subset_closure(low, "p_brand")
