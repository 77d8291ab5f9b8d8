"""Fixed values of text rules: cue patterns of conversation turns, topic slots, words of edit signals.

Results depend on every entry and on their order, so they stand here whole, as text.
"""

# ---- fixed values: turns (patterns ignore case) -------------------------------------------------

CLAUSE = r"[,;:\n]|\b(?:nhưng|mà|tuy\s+nhiên|thay\s+vào\s+đó|ngược\s+lại|however|but|instead)\b"
GUARD_BEFORE = (
    r"\b(?:không|chưa|chẳng|chả|đừng|chớ|khoan|tạm\s+thời\s+chưa|chưa\s+hề|"
    r"đang\s+cân\s+nhắc|cân\s+nhắc|phân\s+vân|thử|đề\s+xuất|gợi\s+ý|dự\s+kiến|có\s+thể|hay\s+là|"
    r"not|never|don't|do\s+not|didn't|did\s+not|haven't|hasn't|cannot|can't|considering|might|propose)\b"
)
GUARD_AFTER = r"^\s*(?:không|chưa|bỏ|hủy|loại\s+bỏ|ngừng|từ\s+bỏ|not|never|drop|reject)\b"
GUARD_BEFORE_CHARS, GUARD_AFTER_CHARS = 36, 28
CONFIRMED = (
    r"\b(?:chốt(?:\s+dùng|\s+chọn|\s+phương\s+án|\s+lấy|\s+giao|\s+nhé|\s+luôn)?|"
    r"quyết\s+định\s+(?:chọn|dùng|lấy|giữ|chuyển\s+sang|quay\s+lại)|thống\s+nhất|"
    r"chuyển\s+(?:[\wÀ-ỹ]+\s+){0,4}sang\s+(?:dùng\s+)?|đổi\s+(?:[\wÀ-ỹ]+\s+){0,3}từ\s+[\wÀ-ỹ0-9._-]+\s+sang\b|"
    r"thay\s+[\wÀ-ỹ0-9._-]+\s+bằng\b|đồng\s+ý\s+(?:chọn|dùng|phương\s+án|hướng|với)|"
    r"quay\s+lại\s+dùng|chuyển\s+hẳn\s+sang|vẫn\s+(?:giữ|dùng)\s+(?:nguyên\s+)?|"
    r"đã\s+duyệt|nhận\s+phụ\s+trách|sẽ\s+phụ\s+trách|đảm\s+nhiệm\s+phần|"
    r"finalized|decided\s+to\s+use|agreed\s+(?:on|to\s+use)|we\s+chose|reverted\s+back\s+to|"
    r"switched\s+to|replaced\s+[\w0-9._-]+\s+with)\b"
)
NEGATED = (
    r"\b(?:bỏ\s+phương\s+án|loại\s+bỏ|không\s+(?:dùng|chọn|lấy)\b.*\bnữa|không\s+(?:thống\s+nhất|đồng\s+ý|chốt|duyệt)|bác\s+bỏ|"
    r"hủy\s+phương\s+án|từ\s+bỏ|dropped|rejected|ruled\s+out|do\s+not\s+use\s+anymore)\b"
)
CONSIDERING = (
    r"\b(?:đang\s+cân\s+nhắc|cân\s+nhắc\s+(?:thêm|dùng|giữa)|đang\s+nghiêng\s+về|"
    r"phân\s+vân|chưa\s+chốt|chưa\s+thống\s+nhất|chưa\s+quyết\s+định|tạm\s+thời\s+nghĩ|"
    r"considering|evaluating|leaning\s+toward|not\s+finalized)\b"
)
PROPOSED = (
    r"\b(?:đề\s+xuất|gợi\s+ý|thử\s+(?:dùng|phương\s+án|nghiệm|chuyển\s+sang)|"
    r"có\s+thể\s+(?:dùng|chọn|thử)|hay\s+là\s+(?:dùng|mình\s+thử)|dự\s+kiến\s+dùng|"
    r"propose|suggest(?:ed)?|might\s+use|could\s+try)\b"
)
OPEN_ISSUE = (
    r"\b(?:đang\s+bị\s+lỗi|gặp\s+lỗi|mất\s+thứ\s+tự|quá\s+tải|tốn\s+ram|bị\s+timeout|"
    r"còn\s+vướng|chưa\s+xử\s+lý\s+xong|blocker|regression|out\s+of\s+memory|deadlock)\b"
)
QUESTION = r"\?\s*$|\b(?:bao\s+nhiêu|là\s+gì|như\s+thế\s+nào|ai\s+(?:phụ\s+trách|nhận|đảm\s+nhiệm)|vì\s+sao|tại\s+sao|khi\s+nào|ngày\s+nào|còn\s+trong\s+lịch\s+sử\s+không)\b"
ANAPHORIC = (
    r"\b(?:phương\s+án\s+(?:\d+|đó|này|trên|vừa\s+nêu|đầu|hai|cuối)|"
    r"hướng\s+(?:đó|này|trên)|cái\s+(?:đó|này|thứ\s+hai|đầu)|như\s+(?:anh|chị|bạn)\s+\w+\s+vừa|"
    r"đồng\s+ý\s+(?:nhé|vậy\s+nhé|luôn)|chốt\s+vậy\s+nhé|theo\s+ý\s+trên|"
    r"option\s+\d+|that\s+option|as\s+proposed\s+above|agreed\s+on\s+that)\b"
)
ANAPHORIC_WORDS = 9
SLOTS = [
    ("slot:messaging_queue", r"\b(?:listen/notify|redis\s+streams|kafka|rabbitmq|bullmq|celery|nats|message\s+broker|event\s+bus|hàng\s+đợi|queue|stream\s+events?)\b"),
    ("slot:vector_store", r"\b(?:qdrant|milvus|pgvector|pinecone|weaviate|faiss|vector\s+(?:db|store|database)|kho\s+vector)\b"),
    ("slot:cache", r"\b(?:redis\s+cache|memcached|bộ\s+nhớ\s+đệm|caching\s+layer)\b"),
    ("slot:database", r"\b(?:database|cơ\s+sở\s+dữ\s+liệu|csdl|\bdb\b|postgresql|postgres|mongodb|mongo|cockroachdb|mysql|mariadb|sqlite|supabase|dynamodb)\b"),
    ("slot:auth", r"\b(?:auth(?:entication|orization)?|xác\s+thực|phân\s+quyền|sso|keycloak|jwt|oauth2?|iam)\b"),
    ("slot:budget", r"\b(?:ngân\s+sách|kinh\s+phí|chi\s+phí\s+tối\s+đa|hạn\s+mức|budget|cost\s+cap)\b"),
    ("slot:deployment", r"\b(?:deploy(?:ment)?|triển\s+khai|hạ\s+tầng|kubernetes|k8s|docker\s+compose|ci/cd)\b"),
]

# ---- fixed values: edit signals between two wordings ---------------------------------------------

#: Words that turn a statement round.
PARTICLES = """
not no never non none neither nor without
không chẳng chưa cấm
не ни без нет
nicht kein keine keinen keinem keiner ohne
pas jamais sans aucun aucune
nunca jamás jamas sin
mai senza niet geen nie bez
لا غير بدون नहीं बिना
ไม่ ห้าม មិន ឥត မ
不 非 無 无 未 勿 莫 否
안 못 불 비 무 미
""".split()
#: Marks that do so written together.
MARKERS = """
ไม่ ไม่ได้ ห้าม មិន ឥត
不 非 無 无 未 否 不可 不得 禁止 严禁 嚴禁
불 비 무 미 불가 금지
""".split()
#: Words that say nothing of their own.
AUXILIARIES = """
is are was were be been being am
can could will would shall should must may might
do does did have has had
được bị có là đã sẽ đang phải
""".split()
NEGATING_PREFIXES = "non dis un in im il ir не без бес des".split()
OPPOSITES = [
    ("true", "false"), ("enable", "disable"), ("enabled", "disabled"),
    ("allow", "deny"), ("allow", "forbid"), ("allow", "prohibit"),
    ("allowed", "denied"), ("allowed", "forbidden"), ("allowed", "prohibited"),
    ("permitted", "prohibited"), ("permitted", "forbidden"), ("permitted", "denied"),
    ("mandatory", "optional"), ("required", "prohibited"), ("required", "forbidden"),
    ("active", "inactive"), ("on", "off"), ("yes", "no"), ("cho", "cấm"),
]
JOINED_OPPOSITES = [
    ("允许", "禁止"), ("允许", "不允许"), ("允许", "严禁"), ("允許", "禁止"), ("允許", "不允許"),
    ("可", "不可"), ("可能", "不可能"), ("有效", "无效"), ("有効", "無効"), ("許可", "禁止"), ("許可", "不許可"),
    ("合法", "非法"), ("合法", "不合法"), ("必須", "不要"), ("必须", "禁止"), ("อนุญาต", "ห้าม"), ("อนุญาต", "ไม่อนุญาต"),
]
LIFECYCLE = "deprecated superseded supersedes replaces obsolete".split()
LIFECYCLE_JOINED = "thaythế bãibỏ hếthiệulực 廃止 已废弃 已废止 废止".split()
#: Units by the scale they stand for.
SCALES = {
    "b": "b", "bytes": "b", "byte": "b",
    "kb": "kb", "kib": "kib",
    "mb": "mb", "megabyte": "mb", "megabytes": "mb", "mib": "mib",
    "gb": "gb", "gigabyte": "gb", "gigabytes": "gb", "gib": "gib",
    "tb": "tb", "tib": "tib",
    "ms": "ms", "millisecond": "ms", "milliseconds": "ms",
    "s": "s", "sec": "s", "secs": "s", "second": "s", "seconds": "s", "giây": "s", "秒": "s",
    "m": "min", "min": "min", "mins": "min", "minute": "min", "minutes": "min", "phút": "min", "分": "min",
    "h": "hr", "hr": "hr", "hrs": "hr", "hour": "hr", "hours": "hr", "giờ": "hr", "時間": "hr", "小时": "hr",
    "d": "day", "day": "day", "days": "day", "ngày": "day", "日": "day", "天": "day",
}
#: A token that is a quantity, a version or a date.
QUANTITY = r"v\d+(?:\.\d+)+|\d+(?:[./:-]\d+)*%?"
