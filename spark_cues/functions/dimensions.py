"""Small fixed dimensions: languages, voices, phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Language names with the code preferred for captions, and spoken words a second where measured.
LANGUAGES = (
    ("Arabic", "ar", 3.0), ("Bengali", "bn", None), ("Chinese (Simplified)", "zh-Hans", 3.0), ("Chinese (Traditional)", "zh-Hant", 3.0), ("Czech", "cs", None), ("Danish", "da", None), ("Dutch", "nl", 3.0), ("English", "en", 3.2), ("Finnish", "fi", None),
    ("French", "fr", 3.4), ("German", "de", 3.0), ("Greek", "el", None), ("Hebrew", "he", None), ("Hindi", "hi", None), ("Hungarian", "hu", None), ("Indonesian", "id", None), ("Italian", "it", 3.5), ("Japanese", "ja", 4.0), ("Korean", "ko", 3.2),
    ("Malay", "ms", None), ("Norwegian", "nb", None), ("Persian", "fa", None), ("Polish", "pl", None), ("Portuguese", "pt", 3.4), ("Romanian", "ro", None), ("Russian", "ru", 2.8), ("Spanish", "es", 3.5), ("Swedish", "sv", None), ("Thai", "th", None),
    ("Turkish", "tr", None), ("Ukrainian", "uk", None), ("Urdu", "ur", None), ("Vietnamese", "vi", None),
)
# Caption codes that stand for a language besides the preferred ones.
OTHER_CODES = (("zh-Hans", "Chinese"), ("zh-Hant", "Chinese"), ("zh", "Chinese"), ("no", "Norwegian"))
# Languages that synthesis supports, with their codes.
SPEAKABLE = (("Chinese", "zh"), ("English", "en"), ("Japanese", "ja"), ("Korean", "ko"), ("German", "de"), ("French", "fr"), ("Russian", "ru"), ("Portuguese", "pt"), ("Spanish", "es"), ("Italian", "it"))
DEFAULT_RATE = 3.0

# A few voice themes; each is offered in every language that synthesis supports.
THEMES = (("narrator", "M", "A calm narrator with an even pace."), ("presenter", "F", "A bright presenter, clear and friendly."), ("teacher", "F", "A patient teacher who stresses key words."), ("announcer", "M", "A deep announcer, slow and firm."))

# Phases of a run in order of precedence, with the text that shows each.
PHASES = ((1, "failed", "error"), (2, "done", "finished"), (3, "synthesising", "segment"), (4, "translating", "translat"), (5, "transcribing", "transcri"), (6, "downloading", "download"))


def languages(spark: SparkSession) -> DataFrame:
    """``(name, code, rate, speakable)``, one row a language; rates default to 3 words a second."""
    can = {name for name, _ in SPEAKABLE}
    return spark.createDataFrame([(n, c, float(r or DEFAULT_RATE), n.split(" (")[0] in can) for n, c, r in LANGUAGES], "name string, code string, rate double, speakable boolean")


def caption_codes() -> list[tuple[str, str]]:
    """``(code, name)`` of every caption code."""
    return [*OTHER_CODES, *((c, n) for n, c, _ in LANGUAGES if not c.startswith("zh"))]


def codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(caption_codes(), "code string, name string")


def themes(spark: SparkSession) -> DataFrame:
    """``(theme, gender, language, instruct, ref_text)`` for every theme and speakable language."""
    rows = [(t, g, n, i, f"Reference reading for {t} in {n}.") for t, g, i in THEMES for n, _ in SPEAKABLE]
    return spark.createDataFrame(rows, "theme string, gender string, language string, instruct string, ref_text string")


def phases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PHASES), "priority int, status string, pattern string")


def values_sql(rows) -> str:
    """A DuckDB VALUES list of the same rows."""

    def cell(v) -> str:
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)

    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
