"""Word lists, alias tables, thresholds and key sets.

Everything here is data that results depend on. Each list can be replaced by
passing a different one to the function that uses it.
"""

from __future__ import annotations

from dataclasses import dataclass

# Phrases that mark a raw text as spam.
SPAM_PHRASES = (
    "giveaway",
    "free gift",
    "subscribe to my channel",
    "make money online",
    "whatsapp me",
    "telegram me",
    "click here",
    "free money",
    "visit my website",
    "nhận quà",
    "kiếm tiền online",
    "đăng ký kênh",
    "liên hệ qua số",
    "click vào",
)

# Fixed value: texts shorter than this after cleaning are noise.
MIN_TEXT_LENGTH = 10

# Words and phrases that mark automated publishers.
BOT_WORDS = ("bot", "robot", "crawler")
BOT_PHRASES = (r"automated\s+feed", "feed-puller")

# The sentiment lexicon.
POSITIVE_PHRASES = (
    "thần tượng",
    "ủng hộ",
    "thành công",
    "hấp dẫn",
    "phấn khích",
    "hài lòng",
)
POSITIVE_WORDS = (
    "love", "great", "awesome", "good", "amazing", "beautiful", "perfect",
    "best", "excellent", "cool", "fan", "like", "thích", "tuyệt", "hay",
    "đẹp", "tốt", "ngon", "yêu", "vui", "mê", "chất",
)
NEGATIVE_PHRASES = (
    "thất vọng",
    "dở tệ",
    "kém chất lượng",
    "lừa đảo",
)
NEGATIVE_WORDS = (
    "bad", "hate", "worst", "awful", "terrible", "boring", "disappointing",
    "crap", "waste", "ghét", "chán", "tệ", "dở", "kém", "yếu", "tồi", "phí",
    "bực", "tức", "nhạt", "ghê", "kinh",
)


@dataclass(frozen=True)
class Lexicon:
    """Word lists that a sentiment classification counts."""

    positive_phrases: tuple[str, ...] = POSITIVE_PHRASES
    positive_words: tuple[str, ...] = POSITIVE_WORDS
    negative_phrases: tuple[str, ...] = NEGATIVE_PHRASES
    negative_words: tuple[str, ...] = NEGATIVE_WORDS


DEFAULT_LEXICON = Lexicon()

# Substrings that mention an aspect.
ASPECT_TERMS = {
    "music": ("music", "song", "soundtrack", "audio", "nhạc", "bài hát", "âm thanh"),
    "visuals": ("graphic", "visual", "art", "animation", "đồ họa", "hình ảnh", "hình"),
    "gameplay": ("gameplay", "play", "mechanics", "chơi", "lối chơi"),
    "story": ("story", "plot", "lore", "narrative", "cốt truyện", "kịch bản", "truyện"),
}

# Languages the text operators accept.
SUPPORTED_LANGUAGES = ("en", "vi")

# Vietnamese words with no keyword value.
VIETNAMESE_STOP_WORDS = (
    "ơi", "à", "ạ", "á", "ý", "ừ", "uh", "ôi", "oi",
    "nhé", "hen", "nha", "nhỉ", "hả", "ha", "he", "hi", "hì",
    "haha", "hehe", "hihi", "ok", "oke", "okay",
    "nè", "nghe", "vãi", "vl", "vcl", "vkl",
    "này", "đó", "đây", "kia", "nào", "gì",
    "mình", "tao", "mày", "nó", "họ", "em", "anh", "chị", "bạn", "ông", "bà",
    "tui", "tôi", "chúng", "chúng tôi", "chúng ta",
    "và", "với", "hoặc", "hay", "mà", "là", "thì", "nhưng", "tuy", "dù",
    "nếu", "vì", "bởi", "do", "nên", "vậy", "thế", "sao",
    "cũng", "đều", "mới", "còn", "vẫn", "đã", "đang", "sẽ",
    "của", "cho", "từ", "khi", "để", "bị", "được",
    "trong", "ngoài", "trên", "dưới", "ra", "vào", "lại", "đi", "ở",
    "tại", "qua", "lên", "xuống", "về", "theo", "giữa",
    "đến", "tới", "sau", "trước", "nay",
    "một", "các", "những", "mọi", "cả", "tất", "toàn", "từng",
    "nhiều", "ít", "số", "vài", "hơn", "nhất", "thêm", "nữa",
    "rất", "quá", "khá", "ghê", "thật", "lắm", "đỉnh", "xỉu",
    "có", "làm", "ko", "rồi",
    "biết", "nghĩ", "thấy", "muốn", "hơi", "chắc", "chứ",
    "nói", "dùng", "xem",
    "lúc", "hôm", "ngày", "luôn",
    "không", "chưa", "chẳng", "đừng", "hết", "xong",
    "video", "clip", "like", "share", "subscribe", "comment", "link", "view",
    "cái",
    "nội", "dung", "cấp", "bản", "hình", "thể", "tự", "dẫn",
    "cao", "thấp", "lớn", "nhỏ", "tốt",
)

# English words with no keyword value.
ENGLISH_STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "do", "does", "did", "will", "would", "shall", "should", "can", "could", "may",
    "might", "must", "need", "dare", "to", "of", "in", "for", "on", "with", "at", "by",
    "from", "as", "into", "through", "during", "before", "after", "above", "below",
    "between", "out", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "where", "when", "why", "how", "all", "each", "every", "both", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "just", "but", "and", "or", "if", "while", "that", "this",
    "these", "those", "it", "its", "i", "me", "my", "we", "our", "you", "your", "he",
    "him", "his", "she", "her", "they", "them", "their", "what", "which", "who", "whom",
    "redacted", "really", "also", "about", "like", "get", "got", "think", "know",
    "want", "see", "look", "make", "go", "come", "take", "give", "say", "tell",
    "good", "great", "much", "many", "well", "even", "still", "already", "right",
    "now", "new", "old", "first", "last", "long", "big", "small", "high", "low",
    "back", "up", "down", "way", "thing", "time", "day", "year", "people", "man",
    "woman", "part", "place", "case", "work", "point", "fact", "lot", "kind",
)

STOP_WORDS = frozenset(VIETNAMESE_STOP_WORDS) | frozenset(ENGLISH_STOP_WORDS)

# Two- and three-word phrases with no keyword value.
COMPOUND_STOP_WORDS = (
    "nội dung", "cấp độ", "cấp bậc", "bản thân", "bản quyền",
    "hình ảnh", "hình thức", "hình dạng", "thể loại", "thể thao",
    "tự động", "tự nhiên", "dẫn đầu", "hướng dẫn",
    "cao cấp", "cao nhất", "tốt nhất", "nhiều hơn",
    "tất cả", "toàn bộ", "mỗi khi", "mọi người",
    "có thể", "có được", "có thêm",
    "nội bộ", "nội địa",
    "a lot", "as well", "of the", "in the", "on the", "at the",
    "for the", "to the", "is a", "are a",
)

# Counter names and the canonical counter each one means.
METRIC_ALIASES = {
    "view": "views",
    "views": "views",
    "view_count": "views",
    "views_count": "views",
    "like": "likes",
    "likes": "likes",
    "like_count": "likes",
    "likes_count": "likes",
    "upvote": "likes",
    "upvotes": "likes",
    "upvote_count": "likes",
    "comment": "comments",
    "comments": "comments",
    "comment_count": "comments",
    "comments_count": "comments",
    "replies": "comments",
    "reply_count": "comments",
}
CANONICAL_METRICS = ("views", "likes", "comments")

# Counters that only ever grow, so a period uses the latest one.
CUMULATIVE_METRICS = (
    "views", "view_count", "likes", "like_count", "comments", "comment_count",
)

# Counters that are search interest rather than engagement.
TREND_METRICS = ("search_interest",)

# Location modes that describe the collector, not the audience.
COLLECTOR_LOCATION_MODES = ("collector", "collector_region", "region", "global")

# Metadata keys and key parts that identify a person.
IDENTITY_KEYS = (
    "account", "actor", "author", "author_name", "avatar", "avatar_url",
    "channel_id", "channel_title", "creator", "email", "handle", "login",
    "owner", "phone", "profile", "profile_url", "user", "user_name", "username",
)
IDENTITY_KEY_PARTS = (
    "account", "actor", "author", "avatar", "channel", "creator", "email",
    "handle", "login", "owner", "phone", "profile", "user", "username",
)
RAW_PAYLOAD_KEY_PARTS = ("payload", "raw")

# Words ignored when brand and candidate texts are compared.
FIT_STOP_WORDS = (
    "a", "an", "the", "and", "or", "of", "to", "in", "is", "for", "with",
    "at", "by", "on", "about", "it", "this", "that", "from", "as", "but",
    "are", "be", "was", "were", "been", "have", "has", "had",
)

# Words that mark a collaboration risk.
RISK_TERMS = (
    "lag", "bug", "crash", "bad", "worst", "toxic", "scandal", "drama",
    "unstable", "fail",
)
