"""Fixed values.

These constants must equal the ones the reviewed recommender uses for its
results to be reproduced.  They are stated here as plain text, in their natural
order, and are compiled into column expressions elsewhere.
"""

# ---------------------------------------------------------------- FIXED VALUES
# Aspect columns of the wide venue table, in order (intent uses the first 7).
ASPECT_COLUMNS = [
    "hall_vibe", "catering", "parking_facility", "transport_access",
    "bridal_room", "guest_flow", "pricing_detail", "service_etc", "disadvantage",
]
INTENT_LABEL_COUNT = 7
INTENT_THRESHOLD = 0.5

# Inline tags written by the tagging step, in order.
INLINE_TAGS = [
    "name", "hall_vibe", "catering", "parking_facility", "transport_access",
    "bridal_room", "guest_flow", "pricing_detail", "service_etc", "disadvantage",
    "in_guarantee",
]
ABSENT_TAG = "None"

# Display tag -> feature column (13 entries).
TAG_MAP = [
    ("주차 편리", "feat_parking_space"),
    ("역 접근성", "feat_subway_access"),
    ("식대가 다양한", "feat_food_price_range"),
    ("고급스러운 요리가 있는", "feat_food_quality"),
    ("디저트가 맛있는", "feat_food_dessert"),
    ("홀에서 식사 제공", "feat_food_serve_type"),
    ("신부대기실이 넓은", "feat_waiting_room_size"),
    ("채광이 들어오는", "feat_waiting_room_light"),
    ("생화장식이 있는", "feat_waiting_room_flower"),
    ("홀에 생화가 많은", "feat_hall_flower"),
    ("천고가 높은", "feat_hall_ceiling"),
    ("넓은", "feat_hall_size"),
    ("가성비 플랜", "feat_value_for_money"),
]

# Region -> keywords in the venue name; first hit wins, else the default.
REGION_KEYWORDS = [
    ("강남/서초", ["강남", "서초", "반포", "신사", "양재", "선릉"]),
    ("영등포/구로", ["영등포", "문래", "신도림", "여의도"]),
    ("송파/강동", ["잠실", "송파", "문정", "강동"]),
    ("마포/강서", ["마포", "공덕", "강서", "마곡", "DMC", "상암"]),
    ("중구/종로", ["종로", "중구", "을지로", "광화문"]),
    ("경기/인천", ["인천", "부천", "수원", "용인", "기흥", "판교", "성남", "분당", "안성", "평택", "천안", "동탄"]),
]
REGION_DEFAULT = "기타/서울"

# Hall-vibe flags -> keywords (any hit sets the flag to 1).
VIBE_FLAGS = [
    ("is_bright", ["밝은", "밝고", "화사한", "화이트"]),
    ("is_dark", ["어두운", "블랙", "호텔식"]),
    ("is_high_ceiling", ["층고", "높은", "높고", "웅장", "트인"]),
    ("is_private", ["단독"]),
    ("is_outdoor", ["야외", "가든", "야외예식"]),
    ("is_grand", ["웅장", "화려한", "넓은", "공간"]),
]

# Negative signals in a review: the match factor becomes -2.0, else 1.0.
NEGATIVE_SIGNALS = ["낮은", "낮아", "협소", "불편", "멀어", "부족", "답답"]
NEGATION_FACTOR = -2.0

# Stopwords of the word document-frequency count.
STOPWORDS = ["있는", "느낌", "예쁜", "로비", "느낌의", "분위기"]
HANGUL_WORD = "[가-힣]{2,}"

# Board boilerplate removed from review texts.
BOILERPLATE = ("*사진 필수 게시판입니다. 꼭 사진 첨부를 해주세요 제목양식: 업체명 + 후기내용 "
               "ex) mmw스튜디오 + 계약후기에요! / mmw한복 + 본식후기입니다 \u200b")

# Required review sections, in order.
REQUIRED_SECTIONS = [
    "1. 베뉴 이름",
    "2. 견적받은 날짜",
    "3. 직접 찍은 사진 첨부 필수 (공사중이거나, 코로나 때문에 못 첨부할시에는 꼭 글로 명시하시고 홈페이지 사진 대체)",
    "3. 직접 찍은 사진 첨부 필수",
    "4. 정가 식대, 대관료 그 외 기타 비용",
    "5. 견적받은 할인가 식대, 대관료 그 외 기타 비용",
    "6. 선택하게 된 계기",
    "7. 아쉬운 점 혹은 걱정되는 점",
    "8. 여러 업체의 정보를 올릴 경우 필히 한 글에 묶어서 올려주세요.",
]

# Article defaults when a field is missing.
DEFAULT_TITLE = "제목없음"
DEFAULT_DATE = "null"
DEFAULT_AUTHOR = "null"
DEFAULT_CONTENT = "내용없음(복사금지 혹은 이미지글)"
LINK_BASE = "https://cafe.naver.com"

# Manual guarantee patches: row index -> value.
GUARANTEE_PATCHES = [(13, 250), (26, 200), (77, 60), (154, 100), (234, 200), (249, 200), (388, 100)]

# Price patterns and defaults.
FOOD_PRICE_PATTERN = r"식대\s*(\d+,?\d*)"
HALL_PRICE_PATTERN = r"대관료\s*(\d+,?\d*)"
FOOD_PRICE_DEFAULT = 80000
HALL_PRICE_UNIT = 10000
HALL_PRICE_DEFAULT = 5000000
FOOD_SENTENCE_WORDS = ["식사", "뷔페", "음식", "밥"]
PARKING_SENTENCE_WORDS = ["주차", "교통", "셔틀", "역"]

# Retrieval constants.
RRF_K = 60
RRF_MISSING_RANK = 100
RETRIEVAL_TOP_N = 50
FINAL_TOP_N = 20
METRIC_K = 10
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# Ordered-tag position weights; later positions weigh 1.0.
TAG_POSITION_WEIGHTS = [3.0, 1.5, 1.0]
TAG_POSITION_DEFAULT = 1.0
BEHAVIOUR_BONUS_R8 = 0.1
BEHAVIOUR_BONUS_R9 = 0.5
FIXED_SIM_R8 = 0.8
MISSING_QUALITY = 3

# Tag keywords -> feature (+2.0 per matching tag), base weight 1.0, +0.5 per click.
TAG_KEYWORDS = [
    ("feat_parking", ["주차"]),
    ("feat_food", ["식사", "뷔페"]),
    ("feat_mood", ["분위기", "홀"]),
]

# Action points: (action, points, minimum stay seconds or None).
ACTION_POINTS_V1 = [("like", 2.0, None), ("stay", 1.0, 10), ("click", 0.2, None), ("survey", 3.0, None)]
ACTION_POINTS_V2 = [("like", 3.0, None), ("stay", 1.0, 15), ("click", 0.2, None)]
STRENGTH_MIN_SCORE = 4

# Model-specific ranking weights (priority catering, service_etc, bridal_room).
PERSONAL_COLUMNS = ["catering", "bridal_room", "service_etc", "disadvantage"]
MODEL_RANK_WEIGHTS = [("catering", 1.5), ("service_etc", 1.2), ("bridal_room", 1.0), ("disadvantage", 1.0)]
MODEL_RANK_OTHER_WEIGHT = 0.5

# Half vector / half tags weights; unknown tags weigh 0.1.
HALF_HALF_WEIGHTS = [("parking", 0.6), ("food", 0.3), ("access", 0.1)]
HALF_HALF_UNKNOWN = 0.1

# Price-food-parking ranking weights and min-max guard.
MINMAX_WEIGHTS = {"w_price": 0.3, "w_food": 0.5, "w_parking": 0.2}
MINMAX_EPS = 1e-5

# Scenario weights of the reviewed scorers.
R1_WEIGHTS = [("feat_parking", 3.0), ("feat_food", 2.0), ("feat_mood", 1.0)]
R3_PRIORITIES = [("feat_parking", 2.0), ("feat_food", 1.5), ("feat_mood", 1.0)]
TAG_KEYWORD_BASE = 1.0
TAG_KEYWORD_BONUS = 2.0
CLICK_BONUS = 0.5
DYNAMIC_SCALE = 5.0
VECTOR_SHARE_R12 = 0.4
TAG_SHARE_R12 = 0.6
HALF_SHARE = 0.5
MATCH_REASON_SUFFIX = " 만족도가 매우 높은 곳이에요!"
REASON_GOOD = "👍 우수"
REASON_FAIR = "👌 보통"
REASON_POOR = "👎 아쉬움"
RANDOM_SEED = 42

# Score buckets.
SENTIMENT_POSITIVE = 2
SENTIMENT_NEGATIVE = -1
SIMILARITY_HIGH = 0.6
SIMILARITY_LOW = 0.3
# ------------------------------------------------------------ END FIXED VALUES
