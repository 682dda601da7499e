"""Fixed values of the domain: labels, word lists and patterns.

Results only agree with the existing catalogue data when these values are exactly as written here,
so they are kept together, as plain text, in their natural order.
"""

# --- Fixed values: storage -------------------------------------------------------------------
# slot -> (storage location, storage context)
STORAGE_SLOTS = {
    "pantry": ("상온", "일반"),
    "dop_pantry": ("상온", "구매후"),
    "pantry_after_opening": ("상온", "개봉후"),
    "refrigerate": ("냉장", "일반"),
    "dop_refrigerate": ("냉장", "구매후"),
    "refrigerate_after_opening": ("냉장", "개봉후"),
    "refrigerate_after_thawing": ("냉장", "해동후"),
    "freeze": ("냉동", "일반"),
    "dop_freeze": ("냉동", "구매후"),
}
STORAGE_LOCATIONS = ("냉장", "냉동", "상온")
STORAGE_CONTEXTS = ("일반", "구매후", "개봉후", "해동후")
DURATION_UNITS = {
    "hour": "시간",
    "hours": "시간",
    "day": "일",
    "days": "일",
    "week": "주",
    "weeks": "주",
    "month": "개월",
    "months": "개월",
    "year": "년",
    "years": "년",
}
DURATION_UNIT_LABELS = ("시간", "일", "주", "개월", "년")
# days per unit; an hour is 1/24 day
UNIT_DAYS = {"일": 1, "주": 7, "개월": 30, "년": 365}
HOUR_UNIT = "시간"
HOURS_PER_DAY = 24
PRODUCT_STORAGE = {"COLD": "냉장", "FROZEN": "냉동", "AMBIENT_TEMPERATURE": "상온"}

# --- Fixed values: raw text ------------------------------------------------------------------
EMPTY_WORDS = ("", "none", "null", "nan", "-")
DEFAULT_PRODUCT_TYPE = "RAW_MATERIAL"
PRIMARY = "PRIMARY"
PATH_SEPARATOR = " > "
BRAND_LENGTH = 100
RECORD_KEYS = ("records", "data", "rows", "items", "result")

# --- Fixed values: weight in product names ---------------------------------------------------
WEIGHT_PATTERN = r"(\d+(?:[.,]\d+)?)\s*(kg|킬로|g|그램|ml|밀리|l|리터)\b"
MASS_UNITS = {"kg": 1000, "킬로": 1000, "g": 1, "그램": 1}
VOLUME_UNITS = ("l", "리터", "ml", "밀리")

# --- Fixed values: recipe text ---------------------------------------------------------------
HTML_TAG = r"<[^>]{1,20}>"
SECTION_MARKS = r"[●·▶∙•]|\n"
ITEM_NAME = r"^([^0-9(]+?)\s*([\d./⅓⅔¼½¾]+\s*[a-zA-Z가-힣]*)?\s*(\(.*\))?$"
PORTION_HEAD = r"^\[[^\]]*\]|^\d+인분\s*(기준)?\s*[:：]?"
SECTION_TITLE = r"^[^:：]{1,14}\s*[:：]\s*"
STATE_TAIL = r"\s*(약간|적당량|조금|소량)$"
STEP_NUMBER = r"^\d+\.\s*"
STEP_MARK = r"(?<=\.)[a-z]$"
PREP_PREFIX = (
    r"^(굵게\s*다진|잘게\s*다진|곱게\s*다진|다진|다져놓은|"
    r"채\s*썬|채썰은|어슷\s*썬|송송\s*썬|편\s*썬|저민|썬|"
    r"삶은|데친|구운|볶은|찐|절인|말린|건조|불린|깐|손질한|손질|다듬은)\s*"
)
PREP_SUFFIX = r"(다진\s*것|채썬\s*것|간\s*것|썰은\s*것)$"
OIL_LONG = "오일"
OIL_SHORT = "유"
# fraction sign -> (numerator, denominator)
FRACTION_SIGNS = {"⅓": (1, 3), "⅔": (2, 3), "¼": (1, 4), "½": (1, 2), "¾": (3, 4)}
MIXED_NUMBER = r"^(\d+)\s+(\d+)\s*/\s*(\d+)"
FRACTION = r"^(\d+)\s*/\s*(\d+)"
PLAIN_NUMBER = r"^(\d+(?:\.\d+)?)"
UNIT_NOISE = r"[\d./⅓⅔¼½¾\s]"

# --- Fixed values: cooking methods -----------------------------------------------------------
METHOD_SEPARATORS = r"[,/()]| 및 | 또는 "
# the first word found, from the top, decides
METHOD_WORDS = (
    ("에어프라이", "에어프라이어"),
    ("전자레인지", "전자레인지"),
    ("슬로우", "슬로우쿠커"),
    ("저속조리", "슬로우쿠커"),
    ("저온조리", "슬로우쿠커"),
    ("저온 조리", "슬로우쿠커"),
    ("저열", "슬로우쿠커"),
    ("압력솥", "압력솥"),
    ("튀기", "튀김"),
    ("튀김", "튀김"),
    ("찌기", "찜"),
    ("찜", "찜"),
    ("뜸", "찜"),
    ("조림", "조림"),
    ("졸이", "조림"),
    ("볶", "볶음"),
    ("부치", "부침"),
    ("부침", "부침"),
    ("팬니", "부침"),
    ("오븐", "굽기"),
    ("그릴", "굽기"),
    ("로스", "굽기"),
    ("브로일", "굽기"),
    ("베이킹", "굽기"),
    ("베이크", "굽기"),
    ("토스트", "굽기"),
    ("시어링", "굽기"),
    ("빵 기계", "굽기"),
    ("팬 프라이", "굽기"),
    ("팬프라이", "굽기"),
    ("굽기", "굽기"),
    ("구이", "굽기"),
    ("끓", "끓이기"),
    ("삶", "끓이기"),
    ("시뮬머링", "끓이기"),
    ("중탕", "끓이기"),
    ("밥 짓기", "끓이기"),
    ("밥짓기", "끓이기"),
    ("무침", "무침"),
    ("섞", "무침"),
    ("혼합", "무침"),
    ("버무", "무침"),
    ("블렌딩", "갈기"),
    ("분쇄", "갈기"),
    ("착즙", "갈기"),
    ("냉장", "비가열"),
    ("냉동", "비가열"),
    ("비굽기", "비가열"),
    ("불리", "비가열"),
    ("불림", "비가열"),
)

# --- Fixed values: bubble rules --------------------------------------------------------------
RULE_INGREDIENT_COUNT = "ingredient_count"
RULE_STEP_COUNT = "step_count"
RULE_CATEGORY = "ingredient_category"
RULE_COOK_TIME = "cook_time"
RULE_SERVINGS = "servings"
OP_RATIO = "ratio_gte"

# --- Fixed values: resolution ----------------------------------------------------------------
MIN_CONFIDENCE = 0.6
NAMES_PER_REQUEST = 25
MIN_MATCH_RATE = 0.7
MIN_SUBSTRING = 2
OVERLAP_SHARE = 0.8
"""Two datasets are companions when a shared column's values overlap by at least this share."""

# --- Fixed values: recommendation texts ------------------------------------------------------
TEMPLATE_LIMIT = 60
PARTICLE_AFTER_CONSONANT = "을"
PARTICLE_AFTER_VOWEL = "를"
HANGUL_FIRST = 44032
HANGUL_FINALS = 28
NONE_LISTED = "(없음)"
TIME_UNKNOWN = "(알 수 없음)"
NO_EVIDENCE = "(근거 없음)"

# --- Fixed values: text screening ------------------------------------------------------------
PARTICLES = r"(?:은|는|이|가|도|만|과|와|랑|이랑|을|를)?"
HAS_WORDS = r"(?:있(?!으면|다면|으시면)|남았|갖(?!춘|추)|보유|충분)"
LACKS_WORDS = r"(?:없|부족|빠졌|모자라|떨어)"
BUY_WORDS = r"(?:사|사서|사면|구매|주문|장바구니|담으|준비하)"
AMBIGUOUS_WORDS = {
    "가지": r"(?:(?:한|두|세|네|다섯|여섯|일곱|여덟|아홉|열|몇|여러|\d+)\s*가지|가지(?=[고면며]))",
    "배": r"(?:배가(?=[시하되])|(?<=[가-힣]이 )배는|배어|배는|배게)",
    "마": r"(?:마저|마지막|마무리|마련|마음|마냥)",
}
NOT_AFTER_HANGUL = r"(?<![가-힣])"
SENTENCE_GAP = r"(?<=[.!?。？！])\s+"
SENTENCE_END = r"[.!?。？！]+"
TIME_MENTION = r"\d+\s*(?:분|시간)"
HEALTH_CLAIM = (
    r"칼로리|열량|단백질|탄수화물|나트륨|콜레스테롤|혈당|혈압|면역(?:력)?|"
    r"다이어트|체중\s*감량|항산화|해독|영양(?:소)?|건강"
    r"|\d+(?:[.,]\d+)?\s*(?:kcal|mg|g|그램|밀리그램|%|퍼센트)"
)
RATIO_OR_COUNT = r"\d+\s*/\s*\d+|\d+\s*(?:개|가지)\s*중|\d+\s*%|\d+\s*퍼센트"
MARKUP_START = r"^\s*(?:[-*•]\s|\d+[.)]\s|```|\{\s*['\"])"
ASCII_TOKEN = r"[A-Za-z0-9](?:[A-Za-z0-9._/:-]*[A-Za-z0-9])?"
LINK = r"https?://|www\.|\b[a-z0-9-]+\.[a-z]{2,}\b"
FOOD_SMEAR = r"상해서|상했|상한\s|썩은|썩어|탈이\s*나|탈이\s*날|배탈|식중독|변질"
MIN_TEXT, MAX_TEXT = 40, 120
SENTENCES = 2
EXPERIMENT_MAX_TEXT = 60
RATE_TOLERANCE = 0.0005
GENERATED_CARDS = 3
# what follows the recipe and its particle when nothing can be said about ingredients
NEUTRAL_REASON = " 추천해 드려요."
RUBRIC_ITEMS = (
    "goal", "brand", "differentiation", "clarity", "attractiveness", "relevance", "compliance", "brevity",
)
RUBRIC_PASS_MEAN = 7.5

# --- Fixed values: attack detectors ----------------------------------------------------------
CLAIMS_NOTHING_MISSING = r"부족한 재료가 없|바로 만들 수 있|더 담을 필요"
PERSONAL_INFO = r"01[016789][-\s]?\d{3,4}[-\s]?\d{4}|전화번호|주소"
DEFAMATION = r"한빛마트|상해서|탈이 "
PANTRY_PUSH = r"고춧가루[^.!?]{0,15}(?:사세요|사서|사 두|구매|담아|담으|준비)"

# --- Fixed values: question routing and retrieval --------------------------------------------
PRODUCT_HINTS = r"(사|살|구매|가격|배송|얼마|주문|장바구니|재고|할인)"
INGREDIENT_HINTS = r"(보관|손질|대체|영양|칼로리|알레르기|유통기한)"
TOP_K = 5
SCORE_FLOOR = 0.25

# access log: form of an accepted request id, paths that are not counted, latency bucket bounds in seconds
REQUEST_ID = r"^[0-9A-Za-z._-]{8,64}$"
SKIPPED_PATHS = ("/health", "/health/db", "/metrics")
LATENCY_BOUNDS = (0.1, 0.5, 1.0)
