"""Labels derived from rows, texts and file probes; first match wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.functions import filters as R
from pairmill.functions import text as X
from pairmill.functions.lexicon import KOREAN, Lexicon
from pairmill.schema import HANGUL, Script

# Markers of source code inside a text.
CODE_MARKS = ("```", "def ", "class ", "import ")


def infer_language(tags: Sequence, c, script: Script = HANGUL) -> Column:
    """Declared tag, then script, then code marks."""
    s = X.text(c)
    arms = []
    for t in tags:
        v = F.lower(X.strip(t))
        arms += [F.when(v.isin(*script.hints), script.hints[0]), F.when(v.isin("en", "english"), "en"), F.when(v == "code", "code")]
    code = R.has_any(s, CODE_MARKS)
    return F.coalesce(*arms, F.when(s.rlike(f"[{script.symbols}]"), script.hints[0]), F.when(code, "code"), F.lit("other"))


def infer_segment(language: Column, script: Script = HANGUL) -> Column:
    home = script.hints[0]
    return F.when(language == home, home).when(language == "code", "code").when(language == "en", "english").otherwise("mixed")


def task_of_language(language: Column, script: Script = HANGUL) -> tuple[Column, Column]:
    home = F.lower(X.strip(language)) == script.hints[0]
    return F.when(home, script.hints[-1]).otherwise("english"), F.when(home, script.hints[0]).otherwise("english")


def language_of_config(c) -> Column:
    """EN_US -> en, KO -> ko, empty -> en."""
    s = F.lower(F.substring_index(X.strip(c), "_", 1))
    return F.when(X.strip(c) == "", "en").otherwise(s)


def infer_domain(task, segment, language, c, script: Script = HANGUL) -> Column:
    """Labels first, with script counts deciding code-looking and unlabelled rows."""
    t, s, g = (F.lower(X.strip(x)) for x in (task, segment, language))
    n, latin = X.script_count(c, script), X.count_in(c, "A-Za-z")
    code = R.has_any(X.text(c), CODE_MARKS + ("public static void",))
    home, name = script.hints[0], script.hints[-1]
    return (
        F.when((t == "code") | (s == "code"), "code")
        .when(code & (n < 24) & (latin > F.floor(1.25 * F.greatest(n, F.lit(1)))), "code")
        .when(t.isin(name, home) | (s == home) | (g == home), name)
        .when(t.isin("english", "en") | s.isin("english", "en") | (g == "en"), "english")
        .when((X.script_ratio_letters(c, script) >= 0.15) & (n >= 6), name)
        .otherwise("other")
    )


def domain_id(task, segment, c, script: Script = HANGUL) -> Column:
    """Trainer ids: 0 code, 1 doc or English, 2 the script's language, 3 other."""
    t, s = F.lower(X.strip(task)), F.lower(X.strip(segment))
    n, latin = X.script_count(c, script), X.count_in(c, "A-Za-z")
    code = R.has_any(X.text(c), CODE_MARKS + ("public static void",))
    return (
        F.when((n >= 16) & (n >= F.floor(0.15 * F.greatest(latin, F.lit(1)))), 2)
        .when((s == "code") | (t == "code") | code, 0)
        .when(s.isin("doc", "english") | (t == "english"), 1)
        .when(n > 0, 2)
        .otherwise(3)
        .cast("long")
    )


def classify_field(path, code_ratio: Column, chat_ratio: Column, script_ratio: Column) -> Column:
    """Path keywords and probe ratios -> struct(field, confidence, reason)."""
    s = F.lower(X.text(path))

    def has(*words):
        return R.has_any(s, words)

    def out(field, conf, reason):
        return F.struct(F.lit(field).alias("field"), F.lit(conf).alias("confidence"), F.lit(reason).alias("reason"))

    chat = has("chat", "auto_gold", "intro_override")
    # Keyword table in order of precedence.
    return (
        F.when(s.endswith(".manifest.json"), out("profile_meta", 0.65, "manifest metadata file"))
        .when(has("/by_field/"), out("other", 0.5, "already generated by-field artifact"))
        .when(has("/quality/") & has("hq_ko_chat"), out("quality_curated", 0.95, "quality curated dataset path"))
        .when(has("session_memory", "continual_buffer"), out("memory_continual", 0.95, "memory/buffer keyword"))
        .when(has("ccl_specbook"), out("ccl_specbook", 0.98, "ccl_specbook keyword"))
        .when(has("logic_reasoning", "expert_reasoning"), out("reasoning_logic", 0.95, "reasoning keyword"))
        .when(has("translation"), out("translation_multilingual", 0.95, "translation keyword"))
        .when(has("router"), out("routing_intent", 0.95, "router keyword"))
        .when(has("identity", "name_patch", "name_disambig"), out("identity_persona", 0.96, "identity/name keyword"))
        .when(has("stages_", "turbo_stage4"), out("stage_curriculum", 0.96, "stage curriculum keyword"))
        .when(has("syllable_profile", "profile"), out("profile_meta", 0.9, "profile/meta keyword"))
        .when(has("ko_clean", "fluency", "ratio_boost", "pure_ko", "ultra_targeted"), out("ko_fluency_targeted", 0.92, "ko fluency keyword"))
        .when((has("code") | (code_ratio >= 0.35)) & has("chat") & has("ko"), out("coding_tech", 0.88, "code keyword or high code ratio; chat/ko keyword"))
        .when(has("code") | (code_ratio >= 0.35), out("coding_tech", 0.88, "code keyword or high code ratio"))
        .when(has("mit_", "slm_mit", "hf_mit", "lang_blend", "domain_mix", "unified"), out("foundation_mit_mix", 0.9, "mit/mix keyword"))
        .when(has("capability_pack") & (code_ratio >= 0.22), out("coding_tech", 0.76, "capability pack with code-like rows"))
        .when(has("capability_pack"), out("reasoning_logic", 0.72, "capability pack default to reasoning"))
        .when(has("kullm") & (code_ratio >= 0.25), out("coding_tech", 0.72, "kullm with code signal"))
        .when(has("kullm"), out("ko_chat_general", 0.72, "kullm general chat keyword"))
        .when(chat & (code_ratio >= 0.28), out("coding_tech", 0.75, "chat dataset with high code ratio"))
        .when(chat, out("ko_chat_general", 0.82, "chat/general keyword"))
        .when(code_ratio >= 0.45, out("coding_tech", 0.6, "fallback by code ratio"))
        .when((script_ratio >= 0.6) & (chat_ratio >= 0.5), out("ko_chat_general", 0.58, "fallback by ko+chat ratio"))
        .otherwise(out("other", 0.5, "no strong keyword/signal"))
    )


def file_category(size_bytes: Column, rows: Column, script_r: Column, en_r: Column, code_r: Column, other_r: Column,
                  name: str = "korean") -> Column:
    """Category of one file from its probe shares and size."""
    return (
        F.when((size_bytes / 1048576.0 < 1.0) & (rows <= 500), "persona_small")
        .when((en_r >= 0.85) & (script_r < 0.05) & (other_r < 0.05), "english_mit")
        .when(other_r >= 0.20, "multilingual")
        .when(code_r >= 0.15, "code")
        .when(script_r >= 0.55, name)
        .otherwise("mixed")
    )


def plan_language(tags: Sequence, c, script: Script = HANGUL) -> Column:
    """Row language for file planning: a two-letter tag of any other language is other_lang."""
    s, arms = X.text(c), []
    for t in tags:
        v = F.lower(X.strip(t))
        arms.append(
            F.when(v.isin(*script.hints), "ko").when(v.isin("en", "english"), "en").when(v == "code", "code")
            .when(v.rlike(r"\A\p{L}{2}\z"), "other_lang")
        )
    return F.coalesce(
        *arms,
        F.when(R.has_any(s, CODE_MARKS), "code"),
        F.when(s.rlike(f"[{script.symbols}]"), "ko"),
        F.when(s.rlike("[A-Za-z]{4,}"), "en"),
        F.lit("other"),
    )


# Language by file extension.
LANG_BY_EXT = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".tsx": "TSX", ".jsx": "JSX", ".java": "Java", ".go": "Go",
    ".rs": "Rust", ".c": "C", ".cpp": "C++", ".cc": "C++", ".h": "C/C++ Header", ".hpp": "C++ Header", ".cs": "C#",
    ".swift": "Swift", ".kt": "Kotlin", ".php": "PHP", ".rb": "Ruby", ".sh": "Shell",
}

# Four case-blind patterns per language; the first language with two hits wins.
LANG_PATTERNS = (
    ("Python", (r"\bdef\s+\w+\(", r"\bimport\s+\w+", r"if __name__ == ['\"]__main__['\"]", r"\bexcept\b")),
    ("JavaScript", (r"\bfunction\s+\w+\(", r"\bconsole\.log\(", r"\bconst\s+\w+", r"\blet\s+\w+")),
    ("TypeScript", (r"\binterface\s+\w+", r"\btype\s+\w+\s*=", r":\s*[A-Z][A-Za-z0-9_<>,\[\]]*", r"\breadonly\b")),
    ("Java", (r"\bpublic\s+class\s+\w+", r"\bpublic\s+static\s+void\s+main", r"\bSystem\.out\.println\(", r"\bimport\s+java\.")),
    ("C#", (r"\bnamespace\s+\w+", r"\busing\s+System", r"\bConsole\.WriteLine\(", r"\bpublic\s+class\s+\w+")),
    ("C++", (r"#include\s*<", r"\bstd::", r"\bint\s+main\s*\(", r"\bcout\s*<<")),
    ("Go", (r"\bpackage\s+main\b", r"\bfunc\s+\w+\(", r"\bfmt\.", r"\bdefer\b")),
    ("Rust", (r"\bfn\s+main\s*\(", r"\blet\s+mut\s+", r"\bprintln!\(", r"\bimpl\s+\w+")),
    ("SQL", (r"\bselect\b", r"\bfrom\b", r"\bwhere\b", r"\bjoin\b")),
    ("HTML", (r"<!doctype html>", r"<html", r"<div", r"<script")),
    ("CSS", (r"\{\s*[a-z-]+\s*:", r"\.[A-Za-z0-9_-]+\s*\{", r"#[A-Za-z0-9_-]+\s*\{", r"@media")),
    ("PHP", (r"<\?php", r"\becho\s+", r"\$\w+", r"->")),
    ("Ruby", (r"\bdef\s+\w+", r"\bputs\s+", r"\bend\b", r"\bclass\s+\w+")),
    ("Shell", (r"#!/bin/(ba)?sh", r"\becho\s+", r"\bexport\s+\w+=", r"\bgrep\b")),
)

# Action keywords and the risk sentence of each action.
ACTIONS = (
    (("http", "request", "response", "fetch", "axios"), "API request handling"),
    (("json", "parse", "serialize", "dump", "loads"), "data parsing/serialization"),
    (("open(", "read(", "write(", "file", "path"), "file I/O operations"),
    (("select ", "insert ", "update ", "delete ", "from "), "database query/update logic"),
    (("test", "assert", "expect(", "unittest", "pytest"), "automated test logic"),
    (("try", "except", "catch", "finally"), "error handling flow"),
    (("async", "await", "promise", "then("), "asynchronous workflow"),
    (("react", "component", "render(", "<div", "usestate"), "UI rendering/state logic"),
    (("sort", "filter", "map(", "reduce("), "collection transformation"),
)
DEFAULT_ACTION = "general utility logic"
RISKS = {
    "API request handling": "timeouts or retry strategy may be missing",
    "data parsing/serialization": "invalid or unexpected input schema may break parsing",
    "file I/O operations": "missing file checks can cause runtime failures",
    "database query/update logic": "unsanitized input can create injection risks",
    "automated test logic": "assertions may not cover edge conditions",
    "error handling flow": "exceptions may be swallowed without actionable logs",
    "asynchronous workflow": "race conditions can appear under concurrency",
    "UI rendering/state logic": "state updates may trigger unintended re-renders",
    "collection transformation": "empty or null inputs may be unhandled",
    "general utility logic": "edge cases and input validation may be insufficient",
}


def language_of_path(path) -> Column:
    ext = F.regexp_extract(F.lower(X.strip(path)), r"(\.[^./\\]+)\z", 1)
    table = F.create_map(*[F.lit(x) for kv in LANG_BY_EXT.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit("Unknown"))


def language_of_code(c) -> Column:
    """struct(lang, cue1, cue2): first language with at least two pattern hits, cues cut to 30 characters."""
    s = F.lower(X.text(c))
    arms = []
    for lang, pats in LANG_PATTERNS:
        cues = F.filter(F.array(*[F.substring(F.regexp_substr(s, F.lit("(?i)" + p)), 1, 30) for p in pats]), lambda x: x.isNotNull())
        arms.append(
            F.when(F.size(cues) >= 2, F.struct(F.lit(lang).alias("lang"), F.get(cues, F.lit(0)).alias("cue1"), F.get(cues, F.lit(1)).alias("cue2")))
        )
    brace = s.rlike("[{};]")

    def fixed(a, b, d):
        return F.struct(F.lit(a).alias("lang"), F.lit(b).alias("cue1"), F.lit(d).alias("cue2"))

    return F.coalesce(
        *arms,
        F.when(brace & s.contains("function"), fixed("JavaScript", "function", "{ ... }")),
        F.when(brace & s.contains("#include"), fixed("C++", "#include", "{ ... }")),
        fixed("Unknown", "syntax markers", "identifier patterns"),
    )


def code_role(path, c) -> Column:
    p, s = F.lower(X.text(path)), F.lower(X.text(c))
    any_ = R.has_any
    return (
        F.when(any_(p, ("/test", "\\test")) | any_(s, ("pytest", "assert ")), "test")
        .when(any_(p, (".tsx", ".jsx", "/components", "\\components")) | s.contains("react"), "frontend")
        .when(any_(p, ("/cli", "\\cli", "command")) | any_(s, ("argparse", "typer", "click.")), "cli")
        .when(any_(p, ("/config", "\\config")) | any_(s, ("eslint", "prettier", "tsconfig")), "config")
        .when(any_(p, ("/algorithms", "\\algorithms")) | s.contains("binary search"), "algorithm")
        .when(any_(p, ("/docs", "\\docs", "readme")), "docs")
        .otherwise("library")
    )


def code_action(c) -> Column:
    s = F.lower(X.text(c))
    return F.coalesce(*[F.when(R.has_any(s, keys), F.lit(label)) for keys, label in ACTIONS], F.lit(DEFAULT_ACTION))


def action_risk(action: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RISKS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, action), F.lit(RISKS[DEFAULT_ACTION]))


def focus_tag(inp, out, term: Column, lex: Lexicon = KOREAN) -> Column:
    """definition / logic / general pool of a clean pair."""
    q, a, t = X.normalize_space(inp), X.normalize_space(out), F.lower(term)
    is_def = q.rlike(R.ux(lex.definition)) & (F.length(t) >= 2) & F.contains(F.lower(a), t)
    logic, math = q.rlike(R.ux(lex.logic)), q.rlike(R.ux(lex.math))
    is_logic = (logic | math) & (~math | a.rlike(r"\d")) & (~logic | a.rlike(R.ux(lex.reason_words)))
    return F.when(is_def, "definition").when(is_logic, "logic").otherwise("general")


def translation_prompt(c, lex: Lexicon = KOREAN) -> Column:
    return R.has_any(F.lower(X.text(c)), lex.translate_hints)


def code_request(c, lex: Lexicon = KOREAN) -> Column:
    s = X.strip(c)
    return R.has_any(F.lower(s), lex.code_hints) | (s.rlike(r"[{}();\[\]<>_=]") & s.rlike("[A-Za-z]{2,}"))


def definition_prompt(c, lex: Lexicon = KOREAN) -> Column:
    return X.normalize_space(c).rlike(R.ux(lex.definition))


def intro_pool(inp, out, lex: Lexicon = KOREAN) -> Column:
    """intro (question and answer), general (neither), null (dropped)."""
    q = X.normalize_space(inp).rlike(R.ci(lex.intro_query_ci))
    a = X.normalize_space(out).rlike(R.ci(lex.intro_answer_ci))
    return F.when(q & a, "intro").when(~q & ~a, "general")
