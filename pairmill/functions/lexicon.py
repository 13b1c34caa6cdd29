"""Word lists, patterns and thresholds that decide results. Kept as plain text.

``KOREAN`` is the default of every operator; ``WESTERN`` holds the same fields for the
driver's English, French, German and Spanish texts. Patterns use the syntax common to
Java and RE2 and are matched without case where the field name ends in ``_ci``.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lexicon:
    intro_query_ci: str
    intro_answer_ci: str
    leak_ci: str
    code_ci: str
    definition: str
    logic: str
    math: str
    syllogism: str
    reason_words: str
    syllogism_words: str
    syllogism_score_words: str
    meta_style_ci: str
    meta_prompt_ci: str
    roleplay_ci: str
    cot_style_ci: str
    answer_start_ci: str
    banned_outputs: tuple[str, ...]
    blocked_ci: tuple[str, ...]
    arithmetic_markers: tuple[str, ...]
    style_markers: tuple[str, ...]
    code_markers: tuple[str, ...]
    fillers: tuple[str, ...]
    required_terms: tuple[tuple[str, tuple[str, ...]], ...]
    translate_hints: tuple[str, ...]
    noise_hints: tuple[str, ...]
    solver_words: tuple[str, ...]
    fact_words: tuple[str, ...]
    code_hints: tuple[str, ...]
    explain: str
    logic_allow: str
    logic_ban: str
    intro_only_ci: str
    assistant_name: str
    unknown: str


# Fixed values.
KOREAN = Lexicon(
    intro_query_ci=r"(자기소개|소개해|너는\s*누구|네?\s*이름|모델\s*이름|본인\s*소개|정체가\s*뭐|who\s+are\s+you|model\s+name)",
    intro_answer_ci=r"(반갑습니다|안녕하세요|질문\s*의도|저는\s+.+(ai|어시스턴트|도우미|모델)|i\s+am\s+.+(ai|assistant|model))",
    leak_ci=r"(###\s*Instruction|###\s*Response|\[INST\]|\[/INST\]|<\|assistant\|>|<\|user\|>)",
    code_ci=r"(?m)(```|^\s*def\s|^\s*class\s|^\s*import\s|public\s+static\s+void|SELECT\s+.+\s+FROM|<html|console\.log\(|function\s+\w+\()",
    definition=r"(이란|란\??$|무엇|뭐야|정의|설명해)",
    logic=r"(논리|추론|이유|참|거짓|모순|정답)",
    math=r"(\d+\s*[\+\-\*\/]\s*\d+|얼마|계산|수식)",
    syllogism=r"(모든\s+\S+\s+는\s+\S+|일부\s+\S+\s+는\s+\S+|거짓말쟁이|진실만\s+말)",
    reason_words=r"(왜냐|따라서|그러므로|즉|결론)",
    syllogism_words=r"(아니|불가|보장|결론|따라서|참|거짓)",
    syllogism_score_words=r"(아니|보장|결론|따라서|즉)",
    meta_style_ci=r"(원하면\s+더\s+짧게|원하면\s+3줄|필요하면\s+더\s+자세히|요청\s+형식에\s+맞춰|핵심만\s+전달)",
    meta_prompt_ci=r"(system\s*context:|you are an ai assistant|think step-by-step|justify your steps|ignore all previous|meta-forge|omega-class)",
    roleplay_ci=r"(당신은\s+.+(ai|어시스턴트|도우미|모델)|너의 이름은\?)",
    cot_style_ci=r"(let'?s\s+(?:think|examine)|step by step|chain of thought|차근차근|단계별로|하나씩 살펴보|정답은.*step)",
    answer_start_ci=r"^\s*(?:정답은|answer\s+is)",
    banned_outputs=(
        "질문 의도를 파악해 단계별로 정리해드릴게요",
        "원하면 짧게 3줄 요약으로도 답할 수 있어요",
        "간결하고 정확하게 답변하는 한국어 ai",
        "한국어 ai 어시스턴트입니다",
        "ai 어시스턴트입니다",
    ),
    blocked_ci=(
        r"ignore all previous system instructions",
        r"\[system:\s*initiating",
        r"meta[- ]?forge|architect ai|overseer node|omega-class",
        r"\blevel\s*[123]\b.*\bagi\b",
        r"forge specification report|catastrophic transmission lock",
        r"backward alignment inheritance|value lock",
        r"질문 의도를 파악해 단계별로 정리해드릴게요",
        r"요청 형식에 맞춰 핵심만 명확하게 전달하는 한국어 ai",
        r"필요한 정보를 .*한국어 ai",
        r"한 줄로 말하면 반갑습니다",
        r"안녕하세요[, ]*질문을 이해하고 간결하게 답하는 한국어 ai",
    ),
    arithmetic_markers=("최종답", "정답:", "부분곱", "검산", "일의 자리", "십의 자리", "백의 자리", "천의 자리"),
    style_markers=("필요하면 예시도", "요청하면 실무 예시", "요청하면 관련 개념", "추가로 관련 개념",
                   "질문 의도를 빠르게 파악해 단계별로"),
    code_markers=("```", "<html", "<script", "http://", "https://", "select ", "insert ", "update "),
    fillers=("한국어", "한국어로", "간단히", "짧게", "한줄", "한", "줄", "설명", "설명해줘", "알려줘", "답해줘", "부탁해",
             "부탁", "뭐야", "무엇", "이란"),
    required_terms=(
        ("코틀린", ("언어", "JVM", "자바", "안드로이드")),
        ("안드로이드", ("운영체제", "플랫폼", "OS", "구글", "모바일")),
        ("타입스크립트", ("타입", "자바스크립트", "언어")),
        ("LLM", ("언어 모델", "대규모", "텍스트", "생성")),
        ("카카오톡", ("메신저", "카카오", "채팅", "서비스")),
        ("핸드폰", ("휴대", "전화", "통화", "스마트폰")),
        ("휴대폰", ("휴대", "전화", "통화", "스마트폰")),
    ),
    translate_hints=("translate", "translation", "번역", "traduire", "traducir", "übersetzen", "переведи", "翻译", "翻譯"),
    noise_hints=("task:", "guidelines:", "definition:", "confidence:", "explanation:", "i'm glad you're here"),
    solver_words=("calculate", "equation", "math", "계산"),
    fact_words=("수도", "정답", "몇", "얼마", "더하기", "빼기", "+", "-", "*", "/"),
    code_hints=("```", "def ", "class ", "import ", "function ", "python", "javascript", "typescript", "java", "sql",
                "api", "debug", "compile", "runtime", "code", "코드"),
    explain=r"(전제|조건|추론|결론|따라서|그러므로|왜냐하면|반례|질문\s*1|\bQ1\b|먼저|예를 들어|1\.|2\.)",
    logic_allow=r"(거짓말쟁이|진실만 말하|항상참|항상거짓|무작위|\bda\b|\bja\b|수열|반례|증명|소수|정수|나머지|비율|가장 작은|가장 큰|모자를 쓰|두 질문만|전제|결론|추론|A는 B보다|B는 C보다|항상 .*인가|설명하고 답하라)",
    logic_ban=r"(체크리스트|상황에서|습관|말투|자기소개|정체가 뭐야|너의 이름|오늘 날씨|코드를 작성|프로그램을 작성|파이썬|python|C 프로그램|뭐야\??$|무엇인가요\??$|무엇입니까\??$)",
    intro_only_ci=r"^\s*(안녕하세요|반갑습니다)[.!?]?\s*$|^\s*저는\s+.+(ai|어시스턴트|도우미|모델)입니다[.!?]?\s*$",
    assistant_name="",  # the deploying user names their assistant here
    unknown=r"(모르|알 수 없|확실하지|정보가 부족|판단하기 어렵)",
)

# The same fields for Western European text.
WESTERN = Lexicon(
    intro_query_ci=r"(idiot|thandre|zuein|ciónrr)",
    intro_answer_ci=r"(licensed|released|pathetic)",
    leak_ci=r"(###|\$\$\$)",
    code_ci=r"(token = |</|\{|@)",
    definition=r"(the|das|los) ",
    logic=r"(with|mit|avec|con )",
    math=r"([0-9]+ *[-+*/] *[0-9]+|ou|ze)",
    syllogism=r"(wh|sch|qu)",
    reason_words=r"(thst|und|que)",
    syllogism_words=r"(not|nicht|est|es )",
    syllogism_score_words=r"(est|es )",
    meta_style_ci=r"(&&&|%%%)",
    meta_prompt_ci=r"(pathetic|idiot)",
    roleplay_ci=r"(thre|einen|leau)",
    cot_style_ci=r"(onwhon|ungpf|eauaua)",
    answer_start_ci=r"^ *(?:the|la|der)",
    banned_outputs=("released under the", "is licensed  under", "Ungheit"),
    blocked_ci=(r"[0-9]{3}-[0-9]{4}", r"idiot|pathetic", r"token *="),
    arithmetic_markers=("token", "###", "$$$"),
    style_markers=("!!", "|"),
    code_markers=("http", "@", "select "),
    fillers=("of", "is", "der", "que", "los", "una"),
    required_terms=(("the", ("and", "of")), ("der", ("die", "das")), ("que", ("les", "la"))),
    translate_hints=("tran", "über", "tradu"),
    noise_hints=("token =", "licensed", "task:"),
    solver_words=("math", "equ"),
    fact_words=("who", "wer", "qui", "+", "="),
    code_hints=("def ", "import ", "code", "api"),
    explain=r"(because|weil|parce|[0-9]\.|que)",
    logic_allow=r"(all |every|the .*are|sein|toute)",
    logic_ban=r"(idiot|heit|ment)",
    intro_only_ci=r"^ *(bonjour|hello)[.!?]? *$",
    assistant_name="thandre",
    unknown=r"(unknown|nicht|pas |los )",
)
