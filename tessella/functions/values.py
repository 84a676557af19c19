"""Limits, word lists and patterns that results depend on. Patterns are Java's."""

from __future__ import annotations

# Limits.
CROP_TOP, CROP_BOTTOM = 0.10, 0.92
META_CROP_TOP, META_CROP_BOTTOM = 0.08, 0.93
HEADER_RATIO = 1.4
HEADER_MAX_CHARS = 80
DEFAULT_FONT_SIZE = 10.0
MAX_WORDS = 30_000
TABLE_CHARS = 4000
BATCH_SIZE = 5
NARRATIVE_SUMMARIES, NARRATIVE_CHARS, NARRATIVE_GLUE = 5, 500, " | "
TOP_SCORE = 10
RATIONALE_CHARS, EVIDENCE_CHARS = 200, 600
PROSE_LIMIT = 0.75
COPYRIGHT_LIMIT = 4
SIMILARITY_LIMIT, SIMILAR_PAIRS = 0.6, 5
CONTEXT_CHARS, OTHER_CHARS = 4000, 1500
FALLBACK_WORDS, COVER_CHARS = 2000, 3000
TOC_TOLERANCE = 2
HEAD_CHARS = 400
CONTENTS_WITHIN = 20
CONTENTS_SEARCH, CONTENTS_PAGES = 15, 4

MODULE_DIMS = ("goal_focus", "text_readability", "pedagogical_clarity", "example_concreteness", "example_coherence")
COURSE_DIMS = ("prerequisite_alignment", "structural_usability", "business_relevance", "fluidity_continuity", "instructional_alignment")
SEGMENT_TYPES = ("instructional", "preface", "exercise", "solution", "reference_table", "frontmatter", "glossary", "summary", "assessment")
LEVELS = ("", "introductory", "intermediate", "advanced", "undergraduate_introductory", "undergraduate_advanced", "graduate")

# Word lists.
RUNNING_HEADERS = ("access. the future of education.", "access for free at openstax.org", "access for free at", "openstax")
BOLD_LABELS = ("example", "syntax", "note", "output", "input", "definition", "program", "result", "solution", "answer", "explanation")
COPYRIGHT_WORDS = (
    "creative commons", "all rights reserved", "isbn", "doi:", "published by", "reproduced without", "prior written consent", "licensed under",
    "licensing, please contact", "rice university", "openstax", "kendall hunt", "arnold ventures", "chan zuckerberg", "attribution", "noncommercial",
)
PREFACE_PHRASES = ("this book", "this course", "this text", "the reader", "chapter by chapter", "how to use", "who should read", "what you will learn", "welcome", "purpose of this")
ROMAN_UNITS = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10}
ROMAN_DIGITS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
MONOSPACE, HEAVY = "Courier|Mono|Code", "Bold|Black|Heavy"

RETRY_SIGNS = ("429", "503", "rate limit", "quota", "service unavailable", "overloaded")

# Patterns of the classification, in the order of its rules.
PREFACE_HEADING = r"(?i)^\s*(?:preface|foreword|about\s+this\s+(?:book|text)|introduction)\s*$"
REFERENCE_HEADING = r"(?i)\b(appendix|table of|reference table|index|quick\s+reference|cheat\s+sheet|summary\s+table|method\s+summary|api\s+reference|command\s+reference)\b"
SOLUTION = r"(?i)^((Solution|Answer|Answers|Solutions)\b|(Answer to|Solution to)\b|(Worked\s+Example|Sample\s+Output|Expected\s+Output)\b)"
EXERCISE_HEADING = (
    r"(?i)^\d+[.)\s]\s*(exercise|practice|problem|question|write\s+a\s+program|assignment|task\s+\d)"
    r"|^(review\s+questions?|practice\s+problems?|checkpoint|try\s+it(\s+yourself)?|self[\-\s]?check|knowledge\s+check|lab\s+exercise|hands[\-\s]on(\s+activity)?"
    r"|activity\s+\d|coding\s+(exercise|challenge)|programming\s+(exercise|challenge))"
)
EXERCISE_LINE = r"(?i)^(Practice\s+\d|Exercise\s+\d|Q\d+[.)]|\b(write a program|create a|implement|design a)\b)"
GLOSSARY_HEADING = r"(?i)^(key\s+terms?|glossary|definitions?|terminology|key\s+vocabulary)$"
DEFINITION_LINE = r"(?m)^\s*\*{0,2}[A-Z][^:—\n]{2,40}[:—–]\s+\S"
SUMMARY_HEADING = r"(?i)^(summary|chapter\s+summary|module\s+summary|section\s+summary)$"
OPTION_LINE = r"(?i)^[a-d]\.\s+\S"
QUESTION_LINE = r"^\d+[.)\s]\s*\S"
FRONT_PARTS = (
    r"^(\s*(table of contents|contents|preface|acknowledgments|about this book|history|sources|foreword|dedication|bibliography|glossary|index|appendix|abbreviations|list of figures|list of tables)\s*)$",
    r"^(about\s+\w[\w\s]+|coverage\s+and\s+scope|pedagogical\s+foundation)",
    r"(UGC|AICTE|JNTUH|JNTU|affiliated\s+to|accredited\s+by|autonomous\s+institution)",
    r"(syllabus|course\s+code|credit\s+hours|scheme\s+of\s+instruction)",
)
INSTITUTION = r"(?i)(autonomous\s+institution|accredited\s+by|affiliated\s+to|UGC|AICTE|JNTU)"
UNIT_WORD = r"(?i)UNIT\s+[IVX\d]+"
TEXTBOOK = r"(?i)(text\s*book|reference\s*book|recommended\s+reading)"
CHAPTER_START = r"(?i)^(chapter|module|unit|part|lesson)\s+[\dIVX]+|^\d+[.)]\s+\S"
MERGE_BARRIER = r"(?i)^(chapter|module|unit|part)\s+\d+"
UNIT_BARRIER = r"(?i)UNIT\s+[–-]?\s*[IVX\d]+"
BULLET_LINE = r"^\s*(?:[-*•●◦▪‣·]|\d+[.)])\s"

# Patterns of pages and lines.
CID = r"\(cid:\d+\)"
FIGURE = r"(?i)^(Fig\.?\s*\d+\.\d+)\s+(.+)"
UNIT_MARKER = r"(?i)UNIT\s*[-–]?\s*([IVX]+|\d+)"
CONTENTS_HEADING = r"(?i)^\s*(contents|table\s+of\s+contents|index)\s*$"
CONTENTS_HEAD = r"(?i)^\s*(table\s+of\s+)?contents?\s*$"
DOTTED_LINE = r"(?i)\.{3,}\s*[\divxlcdm]+\s*$"
TOC_LINE = r"(?i)^\s*((?:\d+(?:\.\d+)*|[IVX]+|Chapter\s+\d+|Ch\.\s*\d+|Part\s+[IVX]+))?\s*\.?\s*([A-Za-z][^.\n]*?)\s*[.\s]{3,}\s*(\d{1,4}|[ivxlcdm]+)\s*$"

# Patterns of metadata.
TITLES = (r"(?im)^title\s*[:\-]\s*(.{5,120})", r"(?m)About\s+([A-Z][^.\n]{10,100})\n")
AUTHORS = (
    r"(?i)(?:senior\s+)?contributing\s+author[s]?\s*\n\s*(?:DR\.?|PROF\.?)?\s*([A-Z]{2,}(?:\s+[A-Z.]{1,5})*(?:\s+[A-Z]{2,})+)",
    r"(?m)\bby\s+([A-Z][a-z]+(?:\s+[A-Z]\.?\s*)?[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)",
    r"(?i)(?:author|written by|prepared by)\s*[:\-]\s*([A-Z][^.\n]{5,80})",
    r"(?i)(?:senior\s+)?contributing\s+author[s]?\s*\n\s*((?:Dr\.|Prof\.)?\s*[A-Z][^.\n]{5,60})",
    r"(?i)(?:author|by)[:\s]+(?:Dr\.|Prof\.)?\s*([A-Z][a-z]+(?:\s+[A-Z]\.?\s*[A-Z][a-z]+)+)",
)
PUBLISHERS = (
    r"[Pp]ublished\s+by\s+([^.\n]{5,80})",
    r"[Cc]opyright\s+(?:\d{4}\s+)?([A-Z][^.\n]{5,60}(?:Press|Publishing|University|Inc\.|LLC|College))",
    r"©\s*\d{4}\s+([A-Z][^.\n]{5,60}(?:Press|Publishing|University|Inc\.|LLC|College))",
    r"(?i)\b(OpenStax(?:\s+College)?)\b",
    r"(?m)^([A-Z][^.\n]{3,50}(?:Press|Publishing|Books|Education))",
)
ISBN = r"(?i)ISBN(?:-1[03])?\s*[:\-]?\s*((?:97[89][-\s]?)?(?:\d[-\s]?){9}[\dXx])"
YEAR = r"\b(20[0-2]\d|19[89]\d)\b"
SUBJECTS = (
    r"(?i)course\s+(?:in|on)\s+([A-Z][^.,]{3,60})",
    r"(?i)textbook\s+(?:for|in|on)\s+([A-Z][^.,]{3,60})",
    r"(?im)^(?:introduction\s+to|foundations?\s+(?:of|in)|fundamentals?\s+of)\s+([A-Z][^.\n]{3,80})",
)
DESCRIPTIONS = (
    r"(?sU)About\s+[\w\s]+?\n\s*([A-Z][^.]{30,400}\.)",
    r"(?iU)(?:this\s+(?:book|textbook|text|course|resource))\s+(?:provides?|covers?|introduces?|is\s+designed\s+to|aims?\s+to)\s+([^.]{30,350}\.)",
    r"(?U)(?:Preface|Introduction)\s*\n+([A-Z][^\n]{50,400})",
)
BOILERPLATE = ("access for free", "if you")
DESCRIPTION_LEAST, DESCRIPTION_CHARS = 30, 400
BAD_AUTHOR = r"^(windows\s+user|administrator|admin|user|root|unknown|default|test|owner|pc|laptop|desktop|student|author|anonymous|n/?a)$"
TOOL_AUTHOR = r"(acrobat|microsoft\s+word|libreoffice|openoffice|latex|tex|wkhtmltopdf|created\s+by|generated\s+by|converted\s+by)"
COURSE_CODE = r"(?i)\s*[\[\(]?\s*[A-Z]{1,5}[-\s]?\d{3,}[A-Z0-9]*\s*[\]\)]?\s*"
TITLE_LABEL = r"(?i)\s*[-–|:]\s*(lecture\s+notes?|syllabus|study\s+material|class\s+notes?|course\s+material|handout|notes?)\s*$"

# Patterns of a course that is a part of a larger one.
TOC_SIGNAL = r"(?i)\b(table of contents|preface|introduction|chapter\s*[01i]|module\s*[01i])\b"
FIRST_CHAPTER = r"(?i)^(chapter|module|unit|part|lesson)\s*(0|1|i|one|first)\b|^(introduction|foundations?|fundamentals?|getting\s+started)\b"
