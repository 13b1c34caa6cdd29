"""Filters and predicates (F) and classifiers (C)."""

from pyspark.sql import functions as F

from pairmill.catalog.base import (BLANK, CHAT, CODE, LET, PAIRS, QA, SYM, TOK, case, cln, cnt, div, kterms, norm, r6, rnd,
                                   rtoks, strp, toks, words_in)
from pairmill.catalog.shaping import runs
from pairmill.functions import classify as C
from pairmill.functions import filters as R
from pairmill.functions import text as X
from pairmill.functions.lexicon import KOREAN, WESTERN
from pairmill.schema import HANGUL, LATIN

D = "doc_id"
KO = "가-힣"
KOL = "A-Za-z가-힣"
ALNUM = r"\p{L}\p{N}"


def ci(pat: str) -> str:
    return "(?i)" + pat.replace("'", "''")


def rx(c: str, pat: str) -> str:
    return f"regexp_matches({c}, '{pat.replace(chr(39), chr(39) * 2)}')"


def outside(c: str, lo: int, hi: int) -> str:
    return f"(length({c}) < {lo} OR length({c}) > {hi})"


BOTH = "input||chr(10)||output"


@case("f01_length_bounds", f"WITH {PAIRS} SELECT doc_id FROM pairs WHERE NOT {outside('input', 20, 60)} AND NOT {outside('output', 300, 2400)}")
def _(t):
    return t.pairs.filter(~R.outside("input", 20, 60) & ~R.outside("output", 300, 2400)).select(D)


@case("f02_missing_pair", f"WITH {PAIRS} SELECT doc_id, source FROM pairs WHERE input='' OR output=''")
def _(t):
    return t.pairs.filter(R.missing_pair("input", "output")).select(D, "source")


def noise(c, run):
    return f"(contains({c}, chr(65533)) OR contains({c}, '??') OR coalesce({run}, false) OR regexp_matches({c}, '\\{{\\*[^{{}}]{{0,400}}\\*\\}}'))"


@case("f03_noise_text", f"""WITH {QA}, r AS ({runs(BOTH, 10, 'qa', 'p_partkey')})
 SELECT q.p_partkey, {noise('q.input||chr(10)||q.output', 'r.hit')} AS noisy FROM qa q LEFT JOIN r USING (p_partkey)""")
def _(t):
    return t.qa.select("p_partkey", R.noise_text(R.merged("input", "output")).alias("noisy"))


QN = "length(text)-length(replace(text,'?',''))"


@case("f04_language_aware_corruption", f"""WITH m AS (SELECT doc_id, lang, text, {cnt('text', SYM)} AS syl, {cnt('text','%#$&!')} AS jam, {cnt('text','*|@')} AS han,
  {cnt('text', r'^\x00-\x7f')} AS wide, length(text) AS n, {QN} AS q FROM documents)
 SELECT doc_id, text='' OR contains(text, chr(65533)) OR (contains(text,'???') AND q>=greatest(8,n//6)) OR (q>=12 AND q>=n//5)
  OR (lang='fr' AND ((syl=0 AND wide>=10 AND jam+han>=8) OR (han>=6 AND han>greatest(2,syl)) OR (jam>=8 AND jam>greatest(4,syl//2)))) AS corrupt FROM m""")
def _(t):
    return t.documents.select(D, R.corrupt_text("text", F.col("lang"), LATIN, jamo="%#$&!", cjk="*|@").alias("corrupt"))


@case("f05_label_only", rf"""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey FROM lineitem
 WHERE regexp_matches(CASE WHEN l_linenumber%2=0 THEN l_returnflag ELSE CAST(l_quantity AS VARCHAR)||CASE WHEN l_tax>0.05 THEN ' kg' ELSE '' END END, '^\s*(?:[A-D]|[0-9]+(?:\.[0-9]+)?)\s*$')""")
def _(t):
    o = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise(
        F.concat(F.col("l_quantity").cast("string"), F.when(F.col("l_tax") > 0.05, " kg").otherwise("")))
    return t.lineitem.filter(R.label_only(o)).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey")


@case("f06_echo", f"""WITH p AS (SELECT doc_id, CASE WHEN doc_id%3=0 THEN '  '||replace(lower(text),' ','  ') ELSE left(text, 40) END AS i, text AS o FROM documents)
 SELECT doc_id, lower({norm('i')})=lower({norm('o')}) AS echo FROM p""")
def _(t):
    i = F.when(F.col(D) % 3 == 0, F.concat(F.lit("  "), F.replace(F.lower("text"), F.lit(" "), F.lit("  ")))).otherwise(F.substring("text", 1, 40))
    return t.documents.select(D, R.echo(i, "text").alias("echo"))


@case("f07_alnum_floor", rf"""WITH {PAIRS}, m AS (SELECT doc_id, {cnt('output', ALNUM)} AS a, length(output) AS n FROM pairs)
 SELECT doc_id, a < greatest(8, n//14) AS chat, a < greatest(8, n//16) AS strict, a < greatest(60, n//2) AS pack FROM m""")
def _(t):
    return t.pairs.select(D, R.alnum_floor("output", 8, 14).alias("chat"), R.alnum_floor("output", 8, 16).alias("strict"),
                          R.alnum_floor("output", 60, 2).alias("pack"))


@case("f08_tier_policy", f"""WITH {PAIRS} SELECT doc_id, CASE WHEN tier NOT IN ('','high') THEN 'tier' WHEN tier='' THEN 'missing_tier' END AS strict,
 CASE WHEN tier NOT IN ('','high','mid') THEN 'tier' WHEN tier='' THEN 'missing_tier' END AS with_mid, CASE WHEN tier NOT IN ('','high') THEN 'tier' END AS with_missing FROM pairs""")
def _(t):
    return t.pairs.select(D, R.first_reason(R.tier_reason("tier")).alias("strict"),
                          R.first_reason(R.tier_reason("tier", allow_mid=True)).alias("with_mid"),
                          R.first_reason(R.tier_reason("tier", allow_missing=True)).alias("with_missing"))


def gate(hint, n, r, mc=6, mr=0.14):
    return f"CASE WHEN {hint} AND {n}<2 THEN 'ko_signal_weak' WHEN NOT {hint} AND ({n}<{mc} OR {r}<{mr}) THEN 'non_ko' END"


@case("f09_language_gate", f"""WITH m AS (SELECT doc_id, lang='fr' AS hint, {cnt('text', SYM)} AS n, {div(cnt('text', SYM), cnt('text', LET))} AS r FROM documents)
 SELECT doc_id, {gate('hint','n','r')} AS reason FROM m""")
def _(t):
    rules = R.language_rules(R.language_hint(["lang"], LATIN), "text", LATIN)
    return t.documents.select(D, R.first_reason(rules).alias("reason"))


BAN = "(" + " OR ".join(f"contains(lower({norm('text')}), '{' '.join(b.split()).lower()}')" for b in WESTERN.banned_outputs) + ")"


@case("f10_banned_substrings", f"SELECT doc_id, source FROM documents WHERE {BAN}")
def _(t):
    return t.documents.filter(R.banned_substrings("text", WESTERN.banned_outputs)).select(D, "source")


@case("f11_blocked_patterns", f"SELECT doc_id FROM documents WHERE {rx(norm('text'), ci('(?:' + '|'.join(WESTERN.blocked_ci) + '|gnu general)'))}")
def _(t):
    return t.documents.filter(R.blocked_patterns("text", WESTERN.blocked_ci, extra=["gnu general", "(broken"])).select(D)


W = WESTERN
QI, QO = norm("input"), norm("output")


@case("f12_intro_leak", f"""WITH {QA} SELECT p_partkey,
 {rx(QI, ci(KOREAN.intro_query_ci))} OR {rx(QO, ci(KOREAN.intro_answer_ci))} OR {rx(QI, ci(KOREAN.leak_ci))} OR {rx(QO, ci(KOREAN.leak_ci))} AS intro_or_leak,
 {QO}='' OR {words_in(QO, KOREAN.banned_outputs, True)} OR (NOT {rx(QI, ci(KOREAN.intro_query_ci))} AND {rx(QO, ci(KOREAN.intro_answer_ci))}) AS style_leak FROM qa""")
def _(t):
    return t.qa.select("p_partkey", R.intro_or_leak("input", "output").alias("intro_or_leak"), R.style_leak("input", "output").alias("style_leak"))


@case("f13_template_leak", f"SELECT doc_id FROM documents WHERE {rx('text', ci(W.leak_ci))}")
def _(t):
    return t.documents.filter(R.template_leak("text", W)).select(D)


@case("f14_code_like", rf"""WITH {CODE} SELECT p_partkey, regexp_matches(code, '(?im)(```|^\s*def\s|^\s*class\s|^\s*import\s|public\s+static\s+void|SELECT\s+.+\s+FROM|<html|console\.log\(|function\s+\w+\()') AS code_like,
 regexp_matches(substr(code, 40), '(?im)(```|^\s*def\s|^\s*class\s|^\s*import\s|public\s+static\s+void|SELECT\s+.+\s+FROM|<html|console\.log\(|function\s+\w+\()') AS tail_like FROM code""")
def _(t):
    return t.code.select("p_partkey", R.code_like("code").alias("code_like"), R.code_like(F.expr("substr(code, 40)")).alias("tail_like"))


AP = rf"""{outside(QI, 2, 140)} OR contains(input, chr(10)) OR regexp_matches({QI}, '\d+\s*[+\-*/=]\s*\d+') OR {words_in(QI, KOREAN.arithmetic_markers + KOREAN.style_markers)} OR {words_in(QI, KOREAN.code_markers, True)}"""


@case("f15_arithmetic_contamination", f"WITH {QA} SELECT p_partkey, {AP} AS bad_prompt FROM qa")
def _(t):
    return t.qa.select("p_partkey", R.arithmetic_prompt("input").alias("bad_prompt"))


@case("f16_license_policy", f"""WITH {QA} SELECT p_partkey, coalesce(upper({strp('license')})='MIT',false) AS mit_only, upper({strp('license')}) IN ('MIT','') AS allow_missing,
 true AS everything, lower({norm('license')}) IN ('mit','mit license') AS is_mit FROM qa""")
def _(t):
    return t.qa.select("p_partkey", R.license_allowed("license").alias("mit_only"), R.license_allowed("license", "allow_missing").alias("allow_missing"),
                       R.license_allowed("license", "all").alias("everything"), R.is_mit("license").alias("is_mit"))


@case("f17_license_file_allowlist", f"""WITH {QA}, tr AS (SELECT DISTINCT p_brand FROM part WHERE p_size=1)
 SELECT p_partkey, CASE WHEN lower({norm('license')}) IN ('mit','mit license') THEN 'row_license' WHEN tr.p_brand IS NOT NULL THEN 'file_allowlist' END AS mit_source
 FROM qa LEFT JOIN tr ON tr.p_brand=qa.source_dataset""")
def _(t):
    return R.license_source(t.qa, t.part.filter("p_size = 1").select("p_brand"), "license", "source_dataset").select("p_partkey", "mit_source")


@case("f18_source_exclusion", f"""WITH {QA} SELECT p_partkey FROM qa WHERE NOT (starts_with(source_dataset,'Brand#2') OR contains(lower({norm('license')}),'generated in-project') OR language='ko')""")
def _(t):
    return t.qa.filter(~R.source_excluded("source_dataset", "language", prefixes=["Brand#2"], banned=["ko"], license_col="license")).select("p_partkey")


@case("f19_definition_relevance", f"""WITH {QA}, k AS (SELECT p_partkey, lower({strp('term')}) AS t, lower({norm('output')}) AS a FROM qa),
 s AS (SELECT p_partkey, t, a, list_distinct(regexp_extract_all(a, '[0-9A-Za-z]{{2,}}')) AS ts FROM k)
 SELECT p_partkey, t<>'' AND NOT (contains(a,t) OR CASE WHEN len(ts)=0 THEN 0 ELSE list_max(list_transform(ts, lambda x: 1.0-levenshtein(t,x)::DOUBLE/greatest(length(t),length(x),1))) END >= 0.86) AS mismatch FROM s""")
def _(t):
    from pairmill.schema import Script

    ascii_script = Script(symbols="A-Za-z", letters="A-Za-z", hints=("en",))
    return t.qa.select("p_partkey", R.definition_mismatch("term", "output", ascii_script).alias("mismatch"))


@case("f20_keyword_overlap", f"""WITH {CHAT}, k AS (SELECT conv_id, turn, input, {kterms('input', W.fillers)} AS q, {kterms('output', W.fillers)} AS a FROM chat)
 SELECT conv_id, turn, len(q)>0 AND len(list_intersect(q,a))=0 AND NOT ({rx('input', W.logic)} OR {rx('input', W.math)} OR {rx('input', W.syllogism)})
  AND ({rx('input', W.definition)} OR len(q)<=4) AS miss, len(list_intersect(q,a))::BIGINT AS shared FROM k""")
def _(t):
    q, a = X.keyword_terms("input", LATIN, W.fillers), X.keyword_terms("output", LATIN, W.fillers)
    return t.chat.select("conv_id", "turn", R.keyword_miss("input", "output", LATIN, W).alias("miss"),
                         F.size(F.array_intersect(q, a)).cast("long").alias("shared"))


@case("f21_answer_shape", rf"""WITH {QA} SELECT p_partkey, CASE WHEN {rx('input', KOREAN.math)} AND NOT regexp_matches(output,'\d') THEN 'math_without_digits'
  WHEN {rx('input', KOREAN.syllogism)} AND NOT {rx('output', KOREAN.syllogism_words)} THEN 'syllogism_weak' END AS reason,
  {rx('output', KOREAN.explain)} OR len(list_filter(string_split(regexp_replace(output, '[.!?](?:{BLANK})+|\n+', chr(1), 'g'), chr(1)), lambda x: {strp('x')}<>''))>=2 AS explained FROM qa""")
def _(t):
    return t.qa.select("p_partkey", R.first_reason(R.answer_shape_rules("input", "output")).alias("reason"), R.has_explanation("output").alias("explained"))


LI = rf"({rx(cln('input'), KOREAN.logic_allow)} OR (regexp_matches({cln('input')},'\d') AND regexp_matches({cln('input')},'[+\-*/=^<>]')))"


@case("f22_logic_input", f"""WITH {QA} SELECT p_partkey, NOT {outside(cln('input'), 6, 520)} AND {LI} AS logic,
 NOT {outside(cln('input'), 8, 260)} AND {LI} AND NOT {rx(cln('input'), KOREAN.logic_ban)} AS strict FROM qa""")
def _(t):
    return t.qa.select("p_partkey", R.logic_input("input").alias("logic"), R.logic_input("input", lo=8, hi=260, use_ban=True).alias("strict"))


def solver(c, lex):
    return rf"(regexp_matches({c},'\d+\s*[+\-*/]\s*\d+') OR (contains({c},'=') AND regexp_matches({c},'\d')) OR {words_in(c, lex.solver_words)})"


IL = f"lower({strp('input')})"
OS = strp("output")
FACT = f"({solver(IL, W)} OR {words_in(IL, W.fact_words)})"


@case("f23_low_quality_response", rf"""WITH {CHAT}, m AS (SELECT conv_id, turn, {IL} AS q, {OS} AS a, lower({OS}) AS low, {cnt(strp('input'), SYM)}>0 AS ins, {cnt(OS, SYM)} AS ns, {cnt(OS,'A-Za-z')} AS nl,
   {kterms(strp('input'), W.fillers)} AS keys, {toks(OS)} AS w, {rtoks(strp('input'))} AS qt, {rtoks(OS)} AS ot, {FACT} AS fact, {solver(IL, W)} AS solv, regexp_replace({OS},'[^{SYM}]','','g') AS sc FROM chat),
  ch AS (SELECT conv_id, turn, unnest(regexp_extract_all(a,'[{SYM}]')) AS ch FROM m),
  prof AS (SELECT ch FROM (SELECT unnest(regexp_extract_all(text,'[{SYM}]')) AS ch FROM documents) GROUP BY ch HAVING count(*)>=300),
  rare AS (SELECT conv_id, turn, avg(CASE WHEN prof.ch IS NULL THEN 1.0 ELSE 0.0 END) AS r FROM ch LEFT JOIN prof ON ch.ch=prof.ch GROUP BY ALL),
  run AS (SELECT conv_id, turn, bool_or(n>8) AS hit FROM (SELECT conv_id, turn, grp, c, count(*) n FROM (SELECT conv_id, turn, c, i-row_number() OVER (PARTITION BY conv_id, turn, c ORDER BY i) AS grp FROM
    (SELECT conv_id, turn, unnest(string_split(a,'')) AS c, generate_subscripts(string_split(a,''),1) AS i FROM m) WHERE c<>chr(10)) GROUP BY ALL) GROUP BY ALL),
  rep AS (SELECT conv_id, turn, bool_or((length(substr(sc,i+2,2))=2 AND substr(sc,i,2)=substr(sc,i+2,2) AND substr(sc,i,1)<>substr(sc,i+1,1)) OR (length(substr(sc,i+3,3))=3 AND substr(sc,i,3)=substr(sc,i+3,3)
     AND NOT (substr(sc,i,1)=substr(sc,i+1,1) AND substr(sc,i,1)=substr(sc,i+2,1)))) AS hit FROM (SELECT conv_id, turn, sc, unnest(range(1, greatest(length(sc)-2,1))) AS i FROM m) GROUP BY ALL)
 SELECT m.conv_id, m.turn, CASE WHEN a='' THEN 'empty' WHEN length(a)<8 AND NOT (fact AND length(a)>=4) THEN 'short' WHEN coalesce(run.hit,false) THEN 'char_run'
   WHEN length(a)-length(replace(a,'?',''))>=10 THEN 'questions' WHEN ins AND ns<2 AND nl>=16 THEN 'latin_heavy' WHEN ins AND ns>=12 AND coalesce(r,0)>=0.08 THEN 'rare_symbols'
   WHEN ins AND ns>=12 AND nl>0 AND ns::DOUBLE/(ns+nl)<0.58 THEN 'script_share'
   WHEN ins AND len(keys)>0 AND len(list_filter(keys, lambda k: contains(low,k)))=0 AND NOT (length(a)<=24 AND fact) THEN 'keyword_miss'
   WHEN ins AND coalesce(rep.hit,false) THEN 'repeated_chunk' WHEN len(w)>=16 AND len(list_distinct(w))::DOUBLE/len(w)<0.34 THEN 'low_diversity'
   WHEN NOT solv AND regexp_matches(low,'\d+\s*[+\-*/]\s*\d+')::INT+(contains(low,'=') AND regexp_matches(low,'\d'))::INT+regexp_matches(low,'(?:^|[^a-z0-9_])(?:result|answer|equation)(?:[^a-z0-9_]|$)')::INT>=2 THEN 'solver_style'
   WHEN NOT ins AND NOT solv AND len(qt)>0 AND len(ot)>0 AND len(list_intersect(qt,ot))=0 THEN 'no_overlap' END AS reason
 FROM m LEFT JOIN rare USING (conv_id,turn) LEFT JOIN run USING (conv_id,turn) LEFT JOIN rep USING (conv_id,turn)""")
def _(t):
    from pairmill.operators.aggregate import symbol_profile
    from pairmill.operators.joins import rare_symbol_ratio

    prof = symbol_profile(t.documents, "text", LATIN).filter("n >= 300").select("ch")
    chat = t.chat.withColumn("rid", F.struct("conv_id", "turn"))
    d = rare_symbol_ratio(chat, "rid", "output", prof, LATIN)
    return d.select("conv_id", "turn", R.low_quality_reason("input", "output", F.col("rare"), LATIN, W).alias("reason"))


@case("f24_translation_quality", rf"""WITH {PAIRS} SELECT doc_id, {words_in('output', W.noise_hints, True)} OR (contains(lower(input),'given the task definition') AND length(output)>420)
  OR len(regexp_extract_all(output, '\n'))>=8 AS low FROM pairs""")
def _(t):
    return t.pairs.select(D, R.low_quality_translation("input", "output", W).alias("low"))


CODE_RE = r"(?im)(```|^\s*def\s|^\s*class\s|^\s*import\s|public\s+static\s+void|SELECT\s+.+\s+FROM|<html|console\.log\(|function\s+\w+\()"


@case("f25_language_dominance", rf"""WITH {QA}, m AS (SELECT p_partkey, input, output AS a, {cnt(BOTH, KO)} AS bn, {div(cnt(BOTH, KO), cnt(BOTH, KOL))} AS br, {cnt('output', KO)} AS n,
   {div(cnt('output', KO), cnt('output', KOL))} AS r, {cnt('output', 'A-Za-z')} AS la, {div(cnt('output', 'A-Za-z'), cnt('output', KOL))} AS lr, length(output) AS size,
   {div(cnt('output', r'{}\[\]<>;=()#`'), 'length(output)')} AS cs FROM qa)
 SELECT p_partkey, CASE WHEN bn<6 OR br<0.12 THEN 'ko_weak' WHEN regexp_matches(input, '{CODE_RE}') OR regexp_matches(a, '{CODE_RE}') THEN 'ko_code_like' WHEN n<4 AND la>=8 THEN 'ko_latin_heavy'
  WHEN size<=40 AND n<=1 AND regexp_matches(a,'[A-Za-z]{{3,}}') THEN 'ko_short_ascii_answer' WHEN size>=24 AND r<0.28 THEN 'ko_output_low_hangul_ratio' WHEN size>=24 AND lr>0.60 THEN 'ko_output_latin_dominant'
  WHEN regexp_matches(a,'^\s*[A-Za-z][A-Za-z0-9_\-+.#]{{2,}}') AND n<=4 THEN 'ko_ascii_lead'
  WHEN regexp_matches(a,'(?i)(?:^|[^a-z0-9_])(?:javascript|typescript|python|java|react|node|sql|html|css|docker|kubernetes|git)(?:[^a-z0-9_]|$)') AND r<0.52 THEN 'ko_code_topic_dominant'
  WHEN cs>0.11 AND r<0.55 THEN 'ko_code_symbol_dominant' END AS reason FROM m""")
def _(t):
    return t.qa.select("p_partkey", R.first_reason(R.language_dominance_rules("input", "output")).alias("reason"))


@case("f26_meta_roleplay", f"""WITH {PAIRS} SELECT doc_id, {rx(BOTH, ci(W.meta_prompt_ci))} OR ({rx('input', ci(W.roleplay_ci))} AND length(output)<80) OR ({rx('output', ci(W.cot_style_ci))} AND length(output)>=40)
 OR ({cnt(BOTH, SYM)}=0 AND length({BOTH})<40) AS meta FROM pairs""")
def _(t):
    return t.pairs.select(D, R.meta_roleplay("input", "output", LATIN, W).alias("meta"))


BIN = "replace(text, ' is ', CASE WHEN doc_id%50=0 THEN chr(2) WHEN doc_id%2=0 THEN chr(1)||chr(3)||chr(4)||chr(5)||chr(6)||chr(7) ELSE ' ' END)"


@case("f27_binary_content", rf"""SELECT doc_id, b='' OR {div(cnt('b', r'\x01-\x08\x0e-\x1f'), 'length(b)', '1.0')}>0.02 AS is_binary FROM (SELECT doc_id, {BIN} AS b FROM documents)""")
def _(t):
    b = F.replace("text", F.lit(" is "), F.when(F.col(D) % 50 == 0, "\x02").when(F.col(D) % 2 == 0, "\x01\x03\x04\x05\x06\x07").otherwise(" "))
    return t.documents.select(D, R.binary_content(b).alias("is_binary"))


def rule_sql(name, key, run):
    p = R.PAIR_RULE_SETS[name]
    i, o = "ci", "co"
    bad = [outside(i, *p["inp"]), outside(o, *p["out"]), f"contains({i}, chr(65533)) OR contains({o}, chr(65533))"]
    if p["run"] is not None:
        bad.append(f"coalesce({run}.mx > {p['run']}, false)")
    if p["script"]:
        bad.append(f"{cnt(i + '||chr(10)||' + o, SYM)} < {p['script']}")
    if p["questions"] is not None:
        bad.append(f"length({i})-length(replace({i},'?',''))>{p['questions']} OR length({o})-length(replace({o},'?',''))>{p['questions']}")
    if name == "replay":
        bad.append(f"contains({i},'???') OR contains({o},'???')")
    return f"NOT ({' OR '.join('(' + b + ')' for b in bad)}) AS {name}"


RUNMAX = """rm AS (SELECT doc_id, max(n) AS mx FROM (SELECT doc_id, grp, c, count(*) n FROM (SELECT doc_id, c, i-row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS grp FROM
 (SELECT doc_id, unnest(string_split(co,'')) AS c, generate_subscripts(string_split(co,''),1) AS i FROM cp) WHERE c<>chr(10)) GROUP BY ALL) GROUP BY doc_id)"""


@case("f28_pair_rules", f"""WITH {PAIRS}, cp AS (SELECT doc_id, {cln('input')} AS ci, {cln('output')} AS co FROM pairs), {RUNMAX}
 SELECT cp.doc_id, {', '.join(rule_sql(n, 'doc_id', 'rm') for n in R.PAIR_RULE_SETS)} FROM cp LEFT JOIN rm USING (doc_id)""")
def _(t):
    return t.pairs.select(D, *[R.pair_rules(n, "input", "output", LATIN).alias(n) for n in R.PAIR_RULE_SETS])


def chat_reason_sql(src: str = "p"):
    return rf"""CASE WHEN i='' OR o='' THEN 'missing_pair' WHEN {outside('i', 2, 1800)} THEN 'input_length' WHEN {outside('o', 12, 2400)} THEN 'output_length'
   WHEN {noise("i||chr(10)||o", 'hit')} THEN 'noise' WHEN regexp_matches(o,'^\s*(?:[A-D]|[0-9]+(?:\.[0-9]+)?)\s*$') THEN 'label_only' WHEN lower(i)=lower(o) THEN 'echo'
   WHEN {cnt('o', ALNUM)}<greatest(8,length(o)//14) THEN 'noisy_output' WHEN tier NOT IN ('','high','mid') THEN 'tier' WHEN false THEN 'missing_tier'
   WHEN hint AND {cnt('i||chr(10)||o', SYM)}<2 THEN 'ko_signal_weak'
   WHEN NOT hint AND ({cnt('i||chr(10)||o', SYM)}<6 OR {div(cnt('i||chr(10)||o', SYM), cnt('i||chr(10)||o', LET))}<0.14) THEN 'non_ko' END"""


NP = f"np AS (SELECT doc_id, source, tier, lang='fr' AS hint, {norm('input')} AS i, {norm('output')} AS o FROM pairs)"
TAGGED = f"""{PAIRS}, {NP}, r AS ({runs("i||chr(10)||o", 10, 'np')}), tagged AS (SELECT np.*, {chat_reason_sql()} AS reason FROM np LEFT JOIN r USING (doc_id))"""


@case("f29_reject_reason", f"""WITH {TAGGED}, ranked AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL, lower(i), lower(o) ORDER BY doc_id)>1 THEN 'duplicate' ELSE reason END AS final FROM tagged)
 SELECT source, coalesce(final,'ok') AS reason, count(*)::BIGINT AS n FROM ranked GROUP BY ALL""")
def _(t):
    from pairmill.plans.curate import reject_report, tag_pairs

    return reject_report(tag_pairs(t.pairs, ["lang"], "tier", LATIN, allow_mid=True, allow_missing=True), "doc_id", "source")


@case("f29_strict_reason", rf"""WITH {QA}, np AS (SELECT p_partkey, language='ko' AS hint, {norm('input')} AS i, {norm('output')} AS o FROM qa), r AS ({runs('o', 12, 'np', 'p_partkey')})
 SELECT p_partkey, CASE WHEN i='' OR o='' THEN 'missing_pair' WHEN {outside('i', 2, 1800)} THEN 'input_length' WHEN {outside('o', 8, 2400)} THEN 'output_length' WHEN {rx('i', ci(KOREAN.intro_query_ci))} THEN 'intro_input'
  WHEN {words_in('o', KOREAN.banned_outputs, True)} THEN 'banned_output_substring' WHEN contains(i||o, chr(65533)) THEN 'replacement_char' WHEN coalesce(hit,false) THEN 'repeat_noise'
  WHEN regexp_matches(o,'^\s*(?:[A-D]|[0-9]+(?:\.[0-9]+)?)\s*$') THEN 'label_only' WHEN lower(i)=lower(o) THEN 'echo' WHEN {cnt('o', ALNUM)}<greatest(8,length(o)//16) THEN 'noisy_output'
  WHEN NOT hint AND ({cnt('i||chr(10)||o', KO)}<6 OR {div(cnt('i||chr(10)||o', KO), cnt('i||chr(10)||o', KOL))}<0.12) THEN 'non_ko' END AS reason FROM np LEFT JOIN r USING (p_partkey)""")
def _(t):
    d = t.qa.select("p_partkey", "language", X.normalize_space("input").alias("i"), X.normalize_space("output").alias("o"))
    return d.select("p_partkey", R.first_reason(R.strict_rules("i", "o", R.language_hint(["language"]))).alias("reason"))


@case("f30_eval_subset", rf"""WITH {QA}, ok AS (SELECT p_partkey, {strp('input')} AS i, {strp('output')} AS o FROM qa WHERE length({strp('input')})>=3 AND length({strp('output')})>=8 AND NOT contains(input,'???') AND NOT contains(output,'???') AND {rx('input', KOREAN.definition)}),
 f AS (SELECT *, row_number() OVER (PARTITION BY i, o ORDER BY p_partkey) AS rn FROM ok) SELECT p_partkey, i AS input, o AS output FROM f WHERE rn=1 ORDER BY p_partkey LIMIT 256""")
def _(t):
    from pairmill.operators.sample import first_rows
    from pairmill.operators.dedup import first_wins

    ok = t.qa.filter(R.definition_question("input") & (F.length(X.strip("output")) >= 8) & ~F.col("output").contains("???"))
    d = first_wins(ok.select("p_partkey", X.strip("input").alias("input"), X.strip("output").alias("output")), ["input", "output"], ["p_partkey"])
    return first_rows(d, 256, "p_partkey")


# ------------------------------------------------------------------ classifiers


@case("c01_infer_language", f"""SELECT doc_id, CASE WHEN lang='fr' THEN 'fr' WHEN lang='en' THEN 'en' WHEN regexp_matches(text,'[{SYM}]') THEN 'fr' WHEN {words_in('text', C.CODE_MARKS)} THEN 'code' ELSE 'other' END AS language FROM documents""")
def _(t):
    return t.documents.select(D, C.infer_language(["lang"], "text", LATIN).alias("language"))


@case("c02_infer_segment", """SELECT doc_id, CASE lang WHEN 'fr' THEN 'fr' WHEN 'en' THEN 'english' ELSE 'mixed' END AS segment, CASE lang WHEN 'fr' THEN 'french' ELSE 'english' END AS task,
 CASE lang WHEN 'fr' THEN 'fr' ELSE 'english' END AS seg2, lower(split_part(upper(lang)||'_X','_',1)) AS cfg FROM documents""")
def _(t):
    task, seg = C.task_of_language("lang", LATIN)
    return t.documents.select(D, C.infer_segment(F.col("lang"), LATIN).alias("segment"), task.alias("task"), seg.alias("seg2"),
                              C.language_of_config(F.concat(F.upper("lang"), F.lit("_X"))).alias("cfg"))


@case("c03_infer_domain", rf"""WITH {PAIRS}, m AS (SELECT doc_id, task_type AS t, lang AS g, {BOTH} AS b, {cnt(BOTH, SYM)} AS n, {cnt(BOTH, 'A-Za-z')} AS la, {div(cnt(BOTH, SYM), cnt(BOTH, LET))} AS r,
  {words_in(BOTH, C.CODE_MARKS + ('public static void',))} AS code FROM pairs)
 SELECT doc_id, CASE WHEN t='code' THEN 'code' WHEN code AND n<24 AND la>floor(1.25*greatest(n,1)) THEN 'code' WHEN t IN ('french','fr') OR g='fr' THEN 'french' WHEN t IN ('english','en') OR g='en' THEN 'english'
  WHEN r>=0.15 AND n>=6 THEN 'french' ELSE 'other' END AS domain,
  CASE WHEN n>=16 AND n>=floor(0.15*greatest(la,1)) THEN 2 WHEN t='code' OR code THEN 0 WHEN t='english' THEN 1 WHEN n>0 THEN 2 ELSE 3 END::BIGINT AS domain_id FROM m""")
def _(t):
    both = R.merged("input", "output")
    return t.pairs.select(D, C.infer_domain("task_type", F.lit(""), "lang", both, LATIN).alias("domain"),
                          C.domain_id("task_type", F.lit(""), both, LATIN).alias("domain_id"))


CF = ["/data/by_field/x.jsonl", "/quality/hq_ko_chat_v1.jsonl", "code_balanced.jsonl", "translation_v1.jsonl", "chat_mix.jsonl", "mit_unified.jsonl", "misc.jsonl"]


@case("c04_field_classify", f"""WITH f AS (SELECT source, CASE replace(source,'src','')::INT%7 {' '.join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(CF))} END AS path,
  avg(CASE WHEN contains(text,'###') THEN 1.0 ELSE 0 END) AS code, avg(CASE WHEN n_chars>1500 THEN 1.0 ELSE 0 END) AS chat, avg(CASE WHEN lang<>'de' THEN 1.0 ELSE 0 END) AS ko FROM documents GROUP BY source)
 SELECT source, CASE WHEN contains(path,'/by_field/') THEN 'other' WHEN contains(path,'hq_ko_chat') THEN 'quality_curated' WHEN contains(path,'translation') THEN 'translation_multilingual'
  WHEN contains(path,'code') OR code>=0.35 THEN 'coding_tech' WHEN contains(path,'mit_') THEN 'foundation_mit_mix' WHEN contains(path,'chat') AND code>=0.28 THEN 'coding_tech' WHEN contains(path,'chat') THEN 'ko_chat_general'
  WHEN code>=0.45 THEN 'coding_tech' WHEN ko>=0.6 AND chat>=0.5 THEN 'ko_chat_general' ELSE 'other' END AS field,
  CASE WHEN contains(path,'/by_field/') THEN 0.5 WHEN contains(path,'hq_ko_chat') THEN 0.95 WHEN contains(path,'translation') THEN 0.95
  WHEN contains(path,'code') OR code>=0.35 THEN 0.88 WHEN contains(path,'mit_') THEN 0.9 WHEN contains(path,'chat') AND code>=0.28 THEN 0.75 WHEN contains(path,'chat') THEN 0.82
  WHEN code>=0.45 THEN 0.6 WHEN ko>=0.6 AND chat>=0.5 THEN 0.58 ELSE 0.5 END::DOUBLE AS confidence FROM f""")
def _(t):
    n = F.regexp_replace("source", "src", "").cast("int") % len(CF)
    f = t.documents.groupBy("source").agg(
        F.avg(F.when(F.col("text").contains("###"), 1.0).otherwise(0.0)).alias("code"),
        F.avg(F.when(F.col("n_chars") > 1500, 1.0).otherwise(0.0)).alias("chat"),
        F.avg(F.when(F.col("lang") != "de", 1.0).otherwise(0.0)).alias("ko"),
    ).withColumn("path", F.element_at(F.array(*[F.lit(p) for p in CF]), n + 1))
    c = C.classify_field("path", F.col("code"), F.col("chat"), F.col("ko"))
    return f.select("source", c.alias("c")).select("source", "c.field", F.col("c.confidence").cast("double").alias("confidence"))


@case("c05_file_plan", f"""WITH l AS (SELECT source, CASE WHEN lang='fr' THEN 'ko' WHEN lang='en' THEN 'en' ELSE 'other_lang' END AS g, strlen(text)*20 AS b FROM documents),
 f AS (SELECT source, sum(b) AS b, count(*) AS n, avg((g='ko')::INT) AS k, avg((g='en')::INT) AS e, avg((g='code')::INT) AS c, avg((g='other_lang')::INT) AS o FROM l GROUP BY source)
 SELECT source, CASE WHEN b/1048576.0<1.0 AND n<=500 THEN 'persona_small' WHEN e>=0.85 AND k<0.05 AND o<0.05 THEN 'english_mit' WHEN o>=0.20 THEN 'multilingual' WHEN c>=0.15 THEN 'code' WHEN k>=0.55 THEN 'korean' ELSE 'mixed' END AS category FROM f""")
def _(t):
    d = t.documents.select("source", C.plan_language(["lang"], "text", LATIN).alias("g"), (F.octet_length("text") * 20).alias("b"))

    def share(v):
        return F.avg((F.col("g") == v).cast("int"))

    f = d.groupBy("source").agg(F.sum("b").alias("b"), F.count("*").alias("n"), share("ko").alias("k"), share("en").alias("e"),
                                share("code").alias("c"), share("other_lang").alias("o"))
    return f.select("source", C.file_category(F.col("b"), F.col("n"), F.col("k"), F.col("e"), F.col("c"), F.col("o")).alias("category"))


LANGS = C.LANG_PATTERNS


def lang_sql():
    def q(p):
        return p.replace("'", "''")

    lists = []
    for lang, pats in LANGS:
        hits = ", ".join(f"nullif(regexp_extract(s, '(?i){q(p)}'), '')" for p in pats)
        lists.append((lang, f"list_filter([{hits}], lambda x: x IS NOT NULL)"))
    arms = " ".join(f"WHEN len({h})>=2 THEN '{lang}|'||left({h}[1],30)||'|'||left({h}[2],30)" for lang, h in lists)
    return f"CASE {arms} WHEN regexp_matches(s,'[{{}};]') AND contains(s,'function') THEN 'JavaScript|function|{{ ... }}' WHEN regexp_matches(s,'[{{}};]') AND contains(s,'#include') THEN 'C++|#include|{{ ... }}' ELSE 'Unknown|syntax markers|identifier patterns' END"


@case("c06_code_language", f"""WITH {CODE}, m AS (SELECT p_partkey, path, lower(CASE WHEN p_partkey%3=0 THEN substr(code, 60) ELSE code END) AS s FROM code)
 SELECT p_partkey, CASE regexp_extract(path,'(\\.[^./]+)$',1) WHEN '.py' THEN 'Python' WHEN '.ts' THEN 'TypeScript' WHEN '.java' THEN 'Java' WHEN '.go' THEN 'Go' ELSE 'Unknown' END AS by_path, {lang_sql()} AS by_code FROM m""")
def _(t):
    body = F.when(F.col("p_partkey") % 3 == 0, F.expr("substr(code, 60)")).otherwise(F.col("code"))
    d = t.code.select("p_partkey", C.language_of_path("path").alias("by_path"), C.language_of_code(body).alias("c"))
    return d.select("p_partkey", "by_path", F.concat_ws("|", "c.lang", "c.cue1", "c.cue2").alias("by_code"))


def action_sql(s):
    return "CASE " + " ".join(f"WHEN {words_in(s, k)} THEN '{a}'" for k, a in C.ACTIONS) + f" ELSE '{C.DEFAULT_ACTION}' END"


@case("c07_code_role", f"""WITH {CODE}, m AS (SELECT p_partkey, lower(path) AS p, lower(code) AS s FROM code), a AS (SELECT *, {action_sql('s')} AS action FROM m)
 SELECT p_partkey, CASE WHEN contains(p,'/test') THEN 'test' WHEN contains(p,'/components') OR contains(s,'react') THEN 'frontend' WHEN contains(p,'/cli') OR contains(p,'command') THEN 'cli' WHEN contains(p,'/config') THEN 'config'
  WHEN contains(p,'/docs') THEN 'docs' ELSE 'library' END AS role, action, CASE action {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in C.RISKS.items())} END AS risk FROM a""")
def _(t):
    d = t.code.select("p_partkey", C.code_role("path", "code").alias("role"), C.code_action("code").alias("action"))
    return d.withColumn("risk", C.action_risk(F.col("action")))


@case("c08_focus_tag", rf"""WITH {QA}, m AS (SELECT p_partkey, {QI} AS q, {QO} AS a, lower(term) AS t FROM qa)
 SELECT p_partkey, CASE WHEN {rx('q', KOREAN.definition)} AND length(t)>=2 AND contains(lower(a),t) THEN 'definition'
  WHEN ({rx('q', KOREAN.logic)} OR {rx('q', KOREAN.math)}) AND (NOT {rx('q', KOREAN.math)} OR regexp_matches(a,'\d')) AND (NOT {rx('q', KOREAN.logic)} OR {rx('a', KOREAN.reason_words)}) THEN 'logic' ELSE 'general' END AS tag FROM m""")
def _(t):
    return t.qa.select("p_partkey", C.focus_tag("input", "output", F.col("term")).alias("tag"))


@case("c09_intent_flags", rf"""WITH {QA}, m AS (SELECT p_partkey, {strp('input')} AS s, lower({strp('input')}) AS q FROM qa)
 SELECT p_partkey, {words_in('q', KOREAN.translate_hints)} AS translation, {words_in('q', KOREAN.code_hints)} OR (regexp_matches(s,'[{{}}();\[\]<>_=]') AND regexp_matches(s,'[A-Za-z]{{2,}}')) AS code,
  {solver('q', KOREAN)} AS solver, {solver('q', KOREAN)} OR {words_in('q', KOREAN.fact_words)} AS fact, {rx(norm('s'), KOREAN.definition)} AS definition FROM m""")
def _(t):
    return t.qa.select("p_partkey", C.translation_prompt("input").alias("translation"), C.code_request("input").alias("code"),
                       R.solver_query("input").alias("solver"), R.factoid("input").alias("fact"), C.definition_prompt("input").alias("definition"))


@case("c10_general_intro_split", f"""WITH {QA}, m AS (SELECT p_partkey, {rx(QI, ci(KOREAN.intro_query_ci))} AS q, {rx(QO, ci(KOREAN.intro_answer_ci))} AS a FROM qa)
 SELECT CASE WHEN q AND a THEN 'intro' WHEN NOT q AND NOT a THEN 'general' ELSE 'dropped' END AS pool, count(*)::BIGINT AS n, sum(p_partkey)::BIGINT AS keys FROM m GROUP BY ALL""")
def _(t):
    d = t.qa.select("p_partkey", F.coalesce(C.intro_pool("input", "output"), F.lit("dropped")).alias("pool"))
    return d.groupBy("pool").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))
