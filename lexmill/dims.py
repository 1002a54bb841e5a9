"""Fixed dimensions: eras, language spellings, strategies, agent taxonomy, cleaning patterns.

The values are part of the data model, so results depend on them; they are stated
as they stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values -------------------------------------------------------------

ERAS = {
    "pre-devolution (1707-1997)": (1707, 1872, 1992),
    "devolution (1998-2004)": (1998, 2000),
    "gaelic-revival (2005-2022)": (2005, 2010, 2015),
    "modern (2023-2025)": (2023, 2025),
}
ERA_RANGES = {
    "pre-devolution (1707-1997)": (1707, 1997),
    "devolution (1998-2004)": (1998, 2004),
    "gaelic-revival (2005-2022)": (2005, 2022),
    "modern (2023-2025)": (2023, 2025),
}
LANGUAGES = {
    "english": "English",
    "beurla": "English",
    "gaelic": "Gaelic",
    "gàidhlig": "Gaelic",
    "gaidhlig": "Gaelic",
    "scots": "Scots",
    "albais": "Scots",
}
STRATEGIES = ("nomination", "predication", "argumentation", "perspectivization", "intensification_mitigation")
TARGET_TERMS = (
    "English", "Gaelic", "Scots", "Scottish", "Gàidhlig", "Gaidhlig", "Beurla", "Albais",
    "language", "tongue", "dialect", "speech", "bilingual", "multilingual", "monolingual", "Bòrd",
)
AGENT_PHRASES = (
    "creative scotland", "bbc scotland", "education scotland", "scottish ministers", "scottish government",
    "scottish parliament", "scottish qualifications authority", "bòrd na gàidhlig", "contracting state", "lord advocate",
)
AGENT_TAXONOMY = {
    "INSTITUTIONAL": (
        "minister", "parliament", "government", "bòrd", "bord", "council", "authority", "board", "body", "commission",
        "executive", "committee", "secretary", "department", "office", "officer", "inspector", "party", "parties",
    ),
    "LEGAL_PROCESS": (
        "act", "section", "regulation", "provision", "order", "schedule", "charter", "treaty", "plan", "policy", "law",
        "article", "measure", "directive", "statute", "subsection", "paragraph",
    ),
    "ABSTRACT": (
        "scotland", "country", "state", "kingdom", "nation", "territory", "area", "region", "crown", "majesty",
    ),
    "PERSON_GROUP": (
        "speaker", "community", "person", "people", "pupil", "teacher", "child", "parent", "member", "user", "group",
        "population", "learner", "resident", "citizen", "individual",
    ),
}
OCR_PAIRS = {
    "tbat": "that",
    "eficient": "efficient",
    "Defcent": "Descent",
    "Scollish": "Scottish",
    "Langudges": "Languages",
    "CHaPtER": "CHAPTER",
    "SUPPoRT": "SUPPORT",
    "fOR": "FOR",
    "LANGuAGE": "LANGUAGE",
    "GaELIC": "GAELIC",
    "ScOtS": "SCOTS",
}
GOVERNMENT_HEADERS = (
    r"(?i)Changes to legislation:.*",
    r"Document Generated:.*",
    r".*View outstanding changes\s*$",
    r"JINDIPERS!?\s*$",
    r"Gaelic Language \(Scotland\) Act 2005 asp 7\s*$",
)
#: Starts of lines that are headers too, each with a text that the line must hold.
GOVERNMENT_STARTS = (("before", "December 2025"), ("appear in the content and are referenced", ""))
PUBLISHER_LINES = (
    r"(?i)©\s*Crown\s+Copyright", r"Crown\s+[Cc]opyright", r"(?i)King'?s\s+Printer", r"(?i)Queen'?s\s+Printer",
    r"(?i)Published by TSO", r"ISBN\s+[\d\-]+", r"www\.tsoshop\.co\.uk", r"TSO\s*$", r"tso\s*$", r"PO Box",
    r"Telephone orders", r"E-mail:", r"Textphone:", r"a Williams Lea", r'"?\d{6}"?\d{6}', r"AINDEFENSS\s*$",
    r"Mail, Telephone", r"Online\s*$", r"customer\.services@",
)
AMENDMENT_OPENER = r"Textual Amendments\s*$"
AMENDMENT_LINES = (
    r"Textual Amendments\s*$",
    r"F\d+\s*$",
    r"S\.\s+\d+.*(?:inserted|substituted|repealed|omitted).*by\s+",
    r"Words in s\.\s+\d+.*(?:inserted|substituted|repealed).*by\s+",
    r"s\.\s+\d+.*(?:inserted|substituted|repealed|word).*by\s+\d{4}",
)
#: Notes that continue a block of amendments.
AMENDMENT_NOTES = (r"F\d+\z", r"S\.S\.I\.\s+\d+", r"\d{4}/\d+,\s+reg\.")
ROLE_PRIORITY = {"agent": 0, "patient": 1, "modifier": 2, "oblique": 3, "other": 4}
MAX_CHUNK_TOKENS, OVERLAP_TOKENS, PREFIX_TOKENS = 384, 64, 40

# ---- tables -------------------------------------------------------------------

YEARS = tuple(y for years in ERAS.values() for y in years)


def era_table(spark: SparkSession) -> DataFrame:
    rows = [(era, i, y) for i, (era, years) in enumerate(ERAS.items()) for y in years]
    return spark.createDataFrame(rows, "era string, era_ord int, year int")


def era_range_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, i, lo, hi) for i, (e, (lo, hi)) in enumerate(ERA_RANGES.items())], "era string, era_ord int, lo int, hi int")


def strategy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(STRATEGIES)), "strategy_ord int, strategy string")
