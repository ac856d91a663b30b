"""These must equal the agreed ones, or results differ.

Word lists, weights, limits, labels and texts only; no logic lives here.
Every operator takes them as keyword defaults, so callers may pass their own.
"""

# --- fixed values: record keywords (pre-screen) ---
RECORD_KEYWORDS = [
    "servitut", "deklaration", "tinglyst", "påtaleberettiget", "byggelinje", "fredning", "vejret",
    "færdselsret", "ledningsret", "hegnsyn", "naturgasledning", "el-ledning", "kloakledning",
    "vandledning", "udstykningsforbud", "bebyggelsesprocent", "lokalplan",
]

# --- fixed values: document classification markers ---
REGISTER_TYPE = "tinglysningsattest"
DEED_TYPE = "akt"
REGISTER_FILENAME_MARKERS = ["tinglysningsattest", "ejendomssumaris", "ejendomsresume", "ejendomsresumé"]
REGISTER_TEXT_MARKERS = [
    "tinglysningsattest", "tinglyste byrder", "landsjerlav:", "landsejerlav:", "matrikelnummer:",
]
DEED_TEXT_MARKERS = ["deklaration", "servitut", "påtaleberettiget", "anmelder"]

# --- fixed values: chunking, OCR batches, register segments, answer budgets ---
MAX_CHUNK_SIZE = 2000
CHUNK_OVERLAP = 200
OCR_BATCH_PAGES = 80
SECONDS_PER_PAGE = 5
SEGMENT_MAX_CHARS = 9000
SEGMENT_MAX_PAGES = 4
SEGMENT_OVERLAP_PAGES = 1
SEGMENT_STATE_VERSION = 1
REGISTER_TOKENS = 16000
DEED_TOKENS = 4096
REPORT_TOKENS = 8192
LOW_PAGE_CUT = 0.4
GOOD_PAGE_CUT = 0.7
HEADING_SKIP = ["tinglysningsattest", "servitutter"]

# --- fixed values: scoring rules in display order: type -> (label, weight, description) ---
SCORING_RULES = {
    "akt_nr": ("Akt nr.", 10, "Eksakt match på normaliseret aktnummer"),
    "date_ref": ("Løbenummer / dato", 5, "Match på hele tinglysningsdatoen med løbenummer"),
    "lob_suffix": ("Løbenummer-suffix", 3, "Match på løbenummer-suffix fra date_reference"),
    "matrikel": ("Matrikel", 2, "Match på matrikelhenvisning fra attestens scope"),
    "title_word": ("Titelord", 1, "Match på lange nøgleord fra canonical-titlen"),
}
TITLE_WORD_MIN = 6
TITLE_STOPWORDS = [
    "vedrørende", "tinglyst", "matrikel", "matriklerne", "ejendommen", "ejere", "servitut", "servitutter",
    "prioritet", "pantegæld", "forud",
]
MIN_SCORE = 2
CONTEXT_WINDOW = 1
MAX_CANDIDATE_CHUNKS = 12
MAX_CANDIDATE_CHARS = 16000

# --- fixed values: selection labels and reasons ---
SELECTION_LABELS = {
    "selected_hit": "Valgt til LLM som hit",
    "selected_context": "Valgt til LLM som kontekst",
    "excluded_char_cap": "Fravalgt pga. tegnloft",
    "excluded_candidate_cap": "Fravalgt pga. top-12 cap",
    "below_threshold": "Match fundet, men under tærskel",
    "hidden": "Skjult",
}
SELECTION_REASONS = {
    "selected_hit": "Chunken nåede minimumscore og er sendt til LLM.",
    "excluded_char_cap": "Chunken var blandt de prioriterede kandidater, men røg ud ved tegnloftet.",
    "excluded_candidate_cap": "Chunken var i kontekstvinduet, men røg ud ved top-12 cap.",
    "below_threshold": "Chunken havde signal, men ikke nok til at blive sendt videre.",
}
SELECTION_NEIGHBOUR_PREFIX = "Chunken er med som nabokontekst til hit på "
SELECTION_NEIGHBOUR_NONE = "Chunken er med som kontekst til et nærliggende hit."

# --- fixed values: answer payload keys ---
ANSWER_LIST_KEYS = ["servitutter", "matches", "items", "results", "data"]
ANSWER_SINGLE_KEYS = ["date_reference", "title", "akt_nr"]

# --- fixed values: report texts ---
SCOPE_YES, SCOPE_NO, SCOPE_MAYBE = "Ja", "Nej", "Måske"
SCOPE_DETAIL_PREFIX = "Vedr. matr.nr. "
SCOPE_DETAIL_JOIN = " og "
TEXT_UNKNOWN = "Ukendt indhold"
TEXT_NOT_REVIEWED = "Akt ikke gennemgået."
TEXT_LOOK_UP = "Kræver opslag i tingbogsakt"
TEXT_NO_DEED_PREFIX = "Ingen aktindhold tilgængeligt — "
NO_AS_OF = "ingen datoafgrænsning"
EMPTY_CELL = "—"
MARKDOWN_HEADER = (
    "| Nr. | Dato/løbenummer | Titel | Byggeri | Beskrivelse | Påtaleberettiget | "
    "Rådighed/tilstand | Offentlig/privatretlig | Håndtering/Handling | Vedrører projektområdet |"
)
MARKDOWN_DIVIDER = "| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |"
EDITOR_MISSING_NR = 10_000

# --- fixed values: status labels and job states ---
PARSE_STATUS_LABELS = {
    "pending": "Afventer OCR", "processing": "Kører OCR", "ocr_done": "OCR færdig", "error": "Fejl",
}
BATCH_STATES = {
    "ocr_done": ("Færdig", "OCR og chunks gemt"),
    "processing": ("Kører", "OCRmyPDF og tekstudtræk i gang"),
    "error": ("Fejl", "Kræver ny kørsel"),
}
BATCH_STATE_QUEUED = ("I kø", "Afventer behandling")
CONFIDENCE_BANDS = ("God", "Lav", "Tom")
SCORING_FIELDS = ("selection_summary", "rules", "chunk_details")
JOB_TERMINAL = ["completed", "failed", "cancelled"]
JOB_ACTIVE = [
    "pending", "browser_started", "waiting_for_login", "login_confirmed", "searching_property",
    "selecting_property", "listing_documents", "downloading_documents", "importing_documents",
]
JOB_HEARTBEAT_TIMEOUT = 300
JOB_READY_TIMEOUT = 600
JOB_WAITING = "waiting_for_login"
TYPE_MESSAGE = "document_type must be 'akt' or 'tinglysningsattest'"
PROGRESS_FINISHED = ["completed", "failed", "skipped"]

# --- fixed values: patterns (Java regex syntax) ---
# Word characters are spelled out because Java's \w and \b only know ASCII.
WORD = r"\p{L}\p{N}_"
BLANK = r"\s\x1c-\x1f\x85\p{Z}"
DATE_PATTERNS = [
    r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"[0-9]{2}/[0-9]{2}-[0-9]{4}",
    r"[0-9]{1,2}\.[" + BLANK + r"]*[" + WORD + r"]+[" + BLANK + r"]*[0-9]{4}",
]
SERIAL_NUMBER = r"[0-9]{6,}-[0-9]+"
ADMIN_HEADER = r"(?i)^dss[" + BLANK + r"]+[0-9]+.{0,50}bulk[" + BLANK + r"]+(sort|hvid)(?![" + WORD + r"])"
ADMIN_HEADER_CHARS = 80
WORD_EDGE = r"(?:(?<![" + WORD + r"])(?=[" + WORD + r"])|(?<=[" + WORD + r"])(?![" + WORD + r"]))"
DATE_REFERENCE = WORD_EDGE + r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}-[0-9A-Za-z./-]+" + WORD_EDGE
ARCHIVE_NUMBER = (
    WORD_EDGE + r"(?:[0-9]+[" + BLANK + r"]*[A-ZÆØÅ][" + BLANK + r"]*-?[" + BLANK + r"]*[0-9]+|[A-ZÆØÅ]-[0-9]+)" + WORD_EDGE
)
PARCEL_TOKEN = r"(?i)" + WORD_EDGE + r"[0-9]+[a-zæøåÆØÅ]{0,3}" + WORD_EDGE
PARCEL_BLOCK = (
    r"(?is)Landsejerlav:[" + BLANK + r"]*(.+?)[" + BLANK + r"]*"
    r"Matrikelnummer:[" + BLANK + r"]*([0-9A-Za-z]+)[" + BLANK + r"]*"
    r"Areal:[" + BLANK + r"]*([0-9]+)[" + BLANK + r"]*m2"
)
DATED_SERIAL = r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})-([0-9]+(?:-[0-9]+)+)"
LOOSE_DATE = r"([0-9]{1,2})[" + BLANK + r"]*[./][" + BLANK + r"]*([0-9]{1,2})[" + BLANK + r"]*[./][" + BLANK + r"]*([0-9]{4})"
TIGHT_DATE = r"([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})"
LONE_YEAR = r"(?<![" + WORD + r"])(1[89][0-9]{2}|20[0-9]{2})(?![" + WORD + r"])"
QUERY_WORD = r"[" + WORD + r"]{3,}"
AMT_WORD = r"(?i)(?<![" + WORD + r"])amt(?![" + WORD + r"])"
FENCED_BLOCK = r"(?is)```(?:json)?[" + BLANK + r"]*(.*?)```"
