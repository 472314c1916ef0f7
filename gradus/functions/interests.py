"""How far an option meets a candidate's interests, by words of its folded name and group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as fn

# Interests and the words that stand for each; those looked for in the name alone;
# words of a name that rule an interest out; other spellings of interests.
KEYWORDS = {
    "kham pha may tinh, du lieu & ai": [
        "cong nghe thong tin", "tin hoc", "khoa hoc may tinh", "ky thuat may tinh", "he thong thong tin", "mang may tinh",
        "truyen thong du lieu", "an toan thong tin", "du lieu", "tri tue nhan tao", "phan mem", "lap trinh",
        "internet van vat", "thuong mai dien tu", "game",
    ],
    "thiet ke, che tao & xay dung": [
        "xay dung", "kien truc", "cong trinh", "giao thong", "co khi", "co dien tu", "dien dien tu", "dien tu",
        "dien cong nghiep", "tu dong hoa", "dieu khien", "o to", "vat lieu", "mo dia chat", "ky thuat moi truong", "cong nghe ky thuat",
    ],
    "kinh doanh & lam viec voi thi truong": [
        "kinh te", "quan tri", "thuong mai", "tai chinh", "ngan hang", "ke toan", "marketing", "logistics", "kinh doanh", "bao hiem",
    ],
    "sang tao noi dung & thiet ke": [
        "thiet ke", "truyen thong", "bao chi", "quang cao", "nghe thuat", "am nhac", "my thuat", "thoi trang", "da phuong tien", "game",
    ],
    "lam viec voi con nguoi & cong dong": [
        "xa hoi", "giao duc", "su pham", "tam ly", "luat", "y te", "dieu duong", "duoc", "van hoa", "quan ly nha nuoc", "cong tac xa hoi",
    ],
}
NAME_ONLY = ["kham pha may tinh, du lieu & ai"]
EXCLUDED = {
    "kham pha may tinh, du lieu & ai": [
        "xay dung", "kien truc", "cong trinh", "giao thong", "co khi", "co dien tu", "dien dien tu", "dien tu",
        "dien cong nghiep", "tu dong hoa", "dieu khien", "o to", "vat lieu", "mo dia chat",
    ],
}
ALIASES = {
    "cong nghe": "kham pha may tinh, du lieu & ai",
    "cong nghe so": "kham pha may tinh, du lieu & ai",
    "may tinh du lieu & ai": "kham pha may tinh, du lieu & ai",
    "may tinh, du lieu & ai": "kham pha may tinh, du lieu & ai",
    "ky thuat & xay dung": "thiet ke, che tao & xay dung",
    "may moc cong trinh & ky thuat": "thiet ke, che tao & xay dung",
    "may moc, cong trinh & ky thuat": "thiet ke, che tao & xay dung",
    "kinh doanh": "kinh doanh & lam viec voi thi truong",
    "kinh doanh & thi truong": "kinh doanh & lam viec voi thi truong",
    "sang tao": "sang tao noi dung & thiet ke",
    "noi dung thiet ke & truyen thong": "sang tao noi dung & thiet ke",
    "xa hoi & cong dong": "lam viec voi con nguoi & cong dong",
    "con nguoi cong dong & dich vu": "lam viec voi con nguoi & cong dong",
}


def folded(text: str) -> str:
    """A request's text as fn.fold makes a column's."""
    import unicodedata

    plain = unicodedata.normalize("NFD", text.lower()).replace("đ", "d")
    return "".join(c for c in plain if not unicodedata.combining(c))


def fit(name: Column, group: Column, interests: list[str], keywords=KEYWORDS, name_only=NAME_ONLY, excluded=EXCLUDED, aliases=ALIASES) -> Column:
    """The share of interests that an option meets: 0 to 1; 0 if none is asked for.

    An interest is met by one of its words in the folded name or group, unless the name holds a
    word that rules it out. An interest that isn't known is its own word. Repeats count once.
    """
    wanted = list(dict.fromkeys(x.strip() for x in interests if x.strip()))
    if not wanted:
        return F.lit(0.0)
    plain = lambda c: F.replace(fn.fold(F.coalesce(c, F.lit(""))), F.lit("_"), F.lit(" "))
    title = plain(name)
    both = F.concat(title, F.lit(" "), plain(group))
    met = F.lit(0.0)
    for interest in wanted:
        key = aliases.get(folded(interest), folded(interest))
        hit = fn.contains_any(title if key in name_only else both, keywords.get(key, [key]))
        met = met + F.when(hit & ~fn.contains_any(title, excluded.get(key, [])), 1.0).otherwise(0.0)
    return met / len(wanted)
