"""Data model: alias lists, canonical pair schema, script profiles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Field aliases of a raw row, tried in this order.
INPUT_KEYS = ("input", "instruction", "prompt", "question", "context")
OUTPUT_KEYS = ("output", "response", "answer", "completion", "target")

# Canonical string fields of a pair row.
PAIR_FIELDS = (
    "input", "output", "task_type", "segment_tag", "language", "_meta_quality_tier",
    "_meta_source_file", "_meta_source_field", "source", "source_dataset", "license",
    "id", "_augment_type",
)

PAIR_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in PAIR_FIELDS])

# Union of every alias a raw JSON line may carry; from_json fills the ones present.
RAW_SCHEMA = T.StructType(
    [
        T.StructField(f, T.StringType())
        for f in dict.fromkeys(
            INPUT_KEYS + OUTPUT_KEYS + ("term",) + PAIR_FIELDS + ("source_path", "source_url", "category", "split",
                                                               "final_answer", "answer_format")
        )
    ]
)


@dataclass(frozen=True)
class Script:
    """Target script of a corpus, written as the inside of a regex character class."""

    symbols: str
    letters: str
    hints: tuple[str, ...]
    particles: tuple[str, ...] = ()
    stopwords: frozenset[str] = field(default_factory=frozenset)

    @property
    def token(self) -> str:
        return "0-9" + self.letters


# Korean profile (default of every operator).
HANGUL = Script(
    symbols="가-힣",
    letters="A-Za-z가-힣",
    hints=("ko", "korean"),
    particles=("인가요", "인가", "이란", "란", "입니다", "이야", "야", "은", "는", "이", "가", "을", "를", "에", "로", "도", "만"),
    stopwords=frozenset(("the", "and", "for", "with", "this", "that", "please", "about")),
)

# Same operators on Western European text: accented letters play the part of the script.
LATIN = Script(
    symbols="À-ÖØ-öø-ÿ",
    letters="A-Za-zÀ-ÖØ-öø-ÿ",
    hints=("fr", "french"),
    particles=("ement", "tion", "keit", "ung", "ing", "en", "er", "es", "s"),
    stopwords=frozenset(("the", "and", "for", "with", "this", "that", "please", "about")),
)
