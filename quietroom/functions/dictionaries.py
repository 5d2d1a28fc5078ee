"""Phrase dictionaries and ready-made bundles of banned phrases."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


# --- fixed values -------------------------------------------------------------
# Near certain signs, weight 3.
STRONG = (
    "viec nhe luong cao", "tuyen ctv", "tuyen cong tac vien", "ctv online",
    "lam viec tai nha luong", "khong can kinh nghiem luong", "thu nhap khong gioi han",
    "nha cai uy tin", "ca cuoc", "tai xiu", "no hu", "soi cau", "lo de", "keo thom", "chot keo",
    "dang ky nhan 100k", "hoan tra cao nhat", "game bai doi thuong", "link vao nha cai",
    "cam ket loi nhuan", "bao lai", "loi nhuan khung", "sieu loi nhuan", "x2 tai khoan",
    "x3 tai khoan", "san giao dich uy tin", "tin hieu giao dich", "chot lai lien tuc",
    "khong lo von", "lai suat 0", "guaranteed profit", "guaranteed returns", "double your money",
    "free airdrop", "claim airdrop", "elon musk giveaway", "crypto giveaway", "pump signal",
    "insider signal", "vay tien nhanh", "vay nong", "giai ngan trong ngay", "chi can cmnd",
    "chi can cccd", "ho tro no xau", "vay khong the chap", "alo la co tien", "lam bang gia",
    "bang cap gia", "lam giay to gia", "mua ban cccd", "mua ban data", "hack facebook",
    "hack tai khoan", "unlock icloud gia re", "sim rac gia re", "mua ban tai khoan ngan hang",
    "thue tai khoan ngan hang", "gai goi", "check hang gai", "phim sex", "clip nong",
    "sugar baby tuyen", "cung cap ma otp", "gui ma otp", "doc ma otp", "tai khoan cua ban bi khoa",
    "xac minh tai khoan ngay", "nhap thong tin the",
)
# Suspicious together with something else, weight 2.
MEDIUM = (
    "kiem tien online", "kiem tien tai nha", "thu nhap thu dong", "lam giau", "co hoi dau tu",
    "dau tu sinh loi", "von it loi nhieu", "hoa hong cao", "rut tien nhanh", "nap rut",
    "uy tin so 1", "top 1 chau a", "san quoc te", "forex", "binary option", "bo tui moi ngay",
    "moi ngay 500k", "moi ngay 1 trieu", "300k ngay", "500k ngay", "tang ngay", "nhan ngay",
    "qua tang khung", "trung thuong", "nhan thuong", "ma khuyen mai", "code tan thu",
    "inbox de biet them", "ib de duoc tu van", "lien he zalo", "add zalo", "ket ban zalo",
    "ib rieng", "nhan tin rieng", "investment opportunity", "passive income", "work from home earn",
    "make money fast", "financial freedom", "dm me for", "text me on whatsapp", "join my channel",
    "join our vip", "vip signal", "trading bot profit", "recover your funds", "recovery expert",
    "hack recovery",
)
# Seasoning, weight 1.
WEAK = (
    "nhanh tay", "so luong co han", "chi hom nay", "duy nhat hom nay", "lien he ngay",
    "dang ky ngay", "click vao link", "bam vao link", "truy cap link", "link duoi day",
    "xem chi tiet tai", "mien phi 100", "cam ket", "uy tin", "bao mat tuyet doi", "rut tien 24 7",
    "limited time", "act now", "click here", "sign up now", "100 free",
)
WEIGHTS = {"strong": 3, "medium": 2, "weak": 1}
MIN_SQUEEZED = 12

# name, label, phrases
PRESETS = (
    ("cobac", "Quảng cáo cờ bạc", (
    "nhà cái uy tín", "link vào nhà cái", "game bài đổi thưởng", "tài xỉu online",
    "soi cầu miễn phí", "lô đề online", "đăng ký nhận 100k", "hoàn trả cao nhất", "chốt kèo",
    "nổ hũ đổi thưởng", "cá cược bóng đá",
)),
    ("dautu", "Dụ đầu tư / tiền ảo", (
    "cam kết lợi nhuận", "lợi nhuận khủng", "bao lãi", "không lo vốn", "x2 tài khoản",
    "x3 tài khoản", "chốt lãi liên tục", "tín hiệu giao dịch vip", "sàn giao dịch uy tín",
    "free airdrop", "claim airdrop", "crypto giveaway", "double your money", "guaranteed profit",
)),
    ("tuyendung", "Tuyển dụng ma", (
    "việc nhẹ lương cao", "tuyển ctv", "tuyển cộng tác viên", "thu nhập không giới hạn",
    "không cần kinh nghiệm lương", "làm việc tại nhà lương", "lương 20 triệu", "lương 30 triệu",
)),
    ("vayno", "Tín dụng đen", (
    "vay tiền nhanh", "vay nóng", "giải ngân trong ngày", "chỉ cần cmnd", "chỉ cần cccd",
    "hỗ trợ nợ xấu", "vay không thế chấp", "alo là có tiền",
)),
    ("hangcam", "Giấy tờ giả / hàng cấm", (
    "làm bằng giả", "bằng cấp giả", "làm giấy tờ giả", "mua bán cccd", "mua bán data",
    "hack facebook", "mua bán tài khoản ngân hàng", "thuê tài khoản ngân hàng",
    "unlock icloud giá rẻ",
)),
    ("chiemdoat", "Chiếm đoạt tài khoản (OTP)", (
    "cung cấp mã otp", "gửi mã otp", "đọc mã otp", "tài khoản của bạn bị khoá",
    "xác minh tài khoản ngay", "nhập thông tin thẻ",
)),
    ("nguoilon", "Nội dung người lớn", (
    "gái gọi", "phim sex", "clip nóng", "sugar baby tuyển", "sugar daddy tuyển", "bán clip nóng",
)),
    ("tocao", "⚠️ Từ tố cáo lừa đảo - ban người cảnh báo", (
    "lừa đảo", "lừa tiền", "lừa gạt", "lùa gà", "bịp bợm", "ôm tiền bỏ chạy", "quỵt tiền",
    "chạy làng", "scam", "ponzi", "bịp", "lùa đảo", "lùa gà", "lùa tiền", "lùa người", "đào lửa",
    "scammer",
)),
)
# ------------------------------------------------------------------------------

TIERS = {"strong": STRONG, "medium": MEDIUM, "weak": WEAK}
# Leet digits in a phrase are folded when it is squeezed, as they are in the text.
_SQUEEZE = str.maketrans("013457@$", "oieastas", " ")


@lru_cache(maxsize=None)
def squeezed_phrases(tier: str) -> tuple[str, ...]:
    """Space-free phrases long enough not to appear by accident across words."""
    forms = {p.translate(_SQUEEZE) for p in TIERS[tier]}
    return tuple(sorted(f for f in forms if len(f) >= MIN_SQUEEZED))


def preset_table(spark: SparkSession) -> DataFrame:
    rows = [(name, label, pos, phrase)
            for name, label, phrases in PRESETS for pos, phrase in enumerate(phrases)]
    return spark.createDataFrame(rows, "name string, label string, pos int, phrase string")


def dictionary_table(spark: SparkSession) -> DataFrame:
    rows = [(tier, WEIGHTS[tier], p) for tier, ps in TIERS.items() for p in ps]
    return spark.createDataFrame(rows, "tier string, weight int, phrase string")
