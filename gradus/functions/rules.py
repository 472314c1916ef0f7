"""Fixed rules over texts: scales, categories of names, notes, regions, skills, questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as fn

# Method of admission -> its scale; methods whose scores have a 30-point form.
SCALES = {"THPTQG": "30", "THPTQG - Thang 40": "40", "DGNLHCM": "1200", "DGNLQGHN": "150", "DGTD": "100", "Học bạ": "Biến thiên"}
OTHER_SCALE, DIRECT, WEIGHTED = "Khác", "THPTQG", "THPTQG - Thang 40"


def scale(method: Column) -> Column:
    out = F.lit(OTHER_SCALE)
    for name, s in SCALES.items():
        out = F.when(method == name, s).otherwise(out)
    return out


def score_30(score: Column, method: Column) -> Column:
    """A score in 30 points: as it is, or three quarters of 40 points, half to even; null for other methods."""
    return F.when(method == DIRECT, score).when(method == WEIGHTED, F.bround(score * 0.75, 2))


def checked_scale(scale: Column, method: Column) -> Column:
    """The scale of a method of the national exam, which is 30 or 40; the job stops at another."""
    wrong = F.raise_error(F.concat(F.lit("national exam with scale "), F.coalesce(scale, F.lit("null"))))
    return F.when(~F.startswith(method, F.lit("THPTQG")) | F.coalesce(scale.isin("30", "40"), F.lit(False)), scale).otherwise(wrong.cast("string"))


def as_number(text: Column) -> Column:
    """A number with a decimal point or comma; null for what is none."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


# Category, words of a folded name that stand for it, confidence; the first that matches counts.
NAME_RULES = [
    ("it", "cong nghe thong tin|tin hoc|ky thuat du lieu|tri tue nhan tao|an toan thong tin|he thong thong tin|ky thuat may tinh|phan mem|mang may tinh|internet van vat", "high"),
    ("logistics", "logistics|chuoi cung ung|van tai|hang hai|cang bien|xuat nhap khau", "high"),
    ("finance", "ke toan|kiem toan|tai chinh|ngan hang|bao hiem", "high"),
    ("marketing", "marketing|truyen thong|quan he cong chung|bao chi|quang cao|noi dung", "high"),
    ("language", "ngon ngu|tieng anh|tieng trung|tieng nhat|tieng han|tieng phap|tieng nga|tieng duc|han nom|trung quoc hoc|nhat ban hoc|han quoc hoc|bien phien dich", "high"),
    ("legal_hr", "luat|phap ly|tu phap|hanh chinh nhan su|quan tri nhan luc|quan l[yi] nha nuoc|thanh tra|van thu|luu tru", "high"),
    ("education", "su pham|giao duc|dao tao giao vien|quan ly giao duc", "high"),
    ("health", "y khoa|y hoc|dieu duong|duoc hoc|rang ham mat|ky thuat y hoc|phuc hoi chuc nang|dinh duong|ho sinh", "high"),
    ("construction", "kien truc|xay dung|bat dong san|quy hoach|do thi|cau duong", "high"),
    ("electrical", "dien tu|dien dien|vien thong|tu dong hoa|ky thuat dien", "high"),
    ("production", "co khi|o to|che tao|ky thuat vat lieu|cong nghe vat lieu|det may|cong nghe may|cong nghe thuc pham|in|giay", "high"),
    ("agriculture", "nong nghiep|lam nghiep|thuy san|thu y|moi truong|nang luong|dia chat", "high"),
    ("tourism", "du lich|khach san|nha hang|am thuc|quan tri dich vu", "high"),
    ("design", "thiet ke|my thuat|am nhac|thanh nhac|dien anh|san khau|thoi trang|nhiep anh|mua", "high"),
    ("business", "quan tri kinh doanh|thuong mai|kinh doanh quoc te|kinh te|quan ly cong nghiep|dau tu", "medium"),
    ("legal_hr", "tam ly|cong tac xa hoi|quan ly nha nuoc|quan he quoc te", "medium"),
]
# Folded group -> category and confidence, where no name rule matches.
GROUP_RULES = {
    "kinh doanh va quan ly": ("business", "medium"),
    "kinh te quan tri kinh doanh thuong mai": ("business", "medium"),
    "may tinh va cong nghe thong tin": ("it", "high"),
    "cong nghe thong tin tin hoc": ("it", "high"),
    "cong nghe ky thuat": ("production", "medium"),
    "ky thuat": ("production", "medium"),
    "kien truc va xay dung": ("construction", "high"),
    "xay dung kien truc giao thong": ("construction", "high"),
    "du lich khach san the thao va dich vu ca nhan": ("tourism", "high"),
    "du lich khach san": ("tourism", "high"),
    "suc khoe": ("health", "high"),
    "y duoc": ("health", "high"),
    "khoa hoc su song": ("health", "medium"),
    "phap luat": ("legal_hr", "high"),
    "luat toa an": ("legal_hr", "high"),
    "nhan su hanh chinh": ("legal_hr", "high"),
    "nong lam nghiep va thuy san": ("agriculture", "high"),
    "thuy san lam nghiep nong nghiep": ("agriculture", "high"),
    "tai nguyen moi truong": ("agriculture", "high"),
    "moi truong va bao ve moi truong": ("agriculture", "high"),
    "bao chi va thong tin": ("marketing", "high"),
    "bao chi marketing quang cao pr": ("marketing", "high"),
    "nghe thuat": ("design", "high"),
    "my thuat am nhac nghe thuat": ("design", "high"),
    "thiet ke do hoa game da phuong tien": ("design", "high"),
    "khoa hoc giao duc va dao tao giao vien": ("education", "high"),
    "su pham giao duc": ("education", "high"),
    "dich vu van tai": ("logistics", "high"),
    "ngoai giao ngoai ngu": ("language", "medium"),
    "san xuat va che bien": ("production", "medium"),
    "o to co khi che tao": ("production", "high"),
    "dien lanh dien tu dien tu dong hoa": ("electrical", "high"),
    "cong nghe sinh hoa": ("health", "medium"),
    "cong nghe che bien thuc pham": ("production", "high"),
    "ke toan kiem toan": ("finance", "high"),
    "tai chinh ngan hang bao hiem": ("finance", "high"),
    "ngoai thuong xuat nhap khau kinh te quoc te": ("logistics", "medium"),
    "hang hai thuy loi thoi tiet": ("logistics", "medium"),
    "cong nghe vat lieu": ("production", "high"),
    "mo dia chat": ("agriculture", "medium"),
    "thoi trang may mac": ("design", "high"),
    "toan va thong ke": ("it", "low"),
    "toan hoc va thong ke": ("it", "low"),
    "dich vu xa hoi": ("other", "low"),
    "cong an quan doi": ("other", "low"),
    "an ninh quoc phong": ("other", "low"),
}


def category(name: Column, group: Column) -> Column:
    """struct(category, basis, confidence) of a subject by its name, else by its group; null if neither is known."""
    of = lambda c, basis, sure: F.struct(F.lit(c).alias("category"), F.lit(basis).alias("basis"), F.lit(sure).alias("confidence"))
    key, group_key = (fn.slug(F.coalesce(c, F.lit(""))) for c in (name, group))
    groups = F.create_map(*[x for g, (c, sure) in GROUP_RULES.items() for x in (F.lit(g), of(c, "major_group_rule", sure))])
    out = F.try_element_at(groups, group_key)
    for c, pattern, sure in reversed(NAME_RULES):
        out = F.when(key.rlike(pattern), of(c, "major_name_keyword", sure)).otherwise(out)
    return out


# Subjects in the order they are looked for; what stands for none of them; words for a doubled subject.
SUBJECTS = ["Tiếng Anh", "Toán", "Ngữ văn", "Vật lý", "Hóa học", "Sinh học", "Lịch sử", "Địa lý", "Ngoại ngữ", "Năng khiếu", "Vẽ mỹ thuật", "Vẽ"]
NO_SUBJECT, DOUBLED = "Không_xác_định_môn", ["hệ số 2", "nhân 2", "nhân hệ số 2", "x2"]
MALE, FEMALE, BOTH = "Nam", "Nữ", "Cả hai"
CAMPUS = r"(?iu)(?:Phân hiệu|Cơ sở)\s+([^,;]+)"
WANTED = r"TTNV\s*[<=]+\s*([0-9]+)"
WEIGHT = rf"(?iu)({'|'.join(SUBJECTS)})\s*(?:hệ số|nhân)\s*([0-9]+(?:[.,][0-9]+)?)"
GIRLS, BOYS = r"thí\s+sinh\s+nữ|chỉ\s+tuyển\s+nữ", r"thí\s+sinh\s+nam|chỉ\s+tuyển\s+nam"
QUALITY = r"chất\s+lượng\s+cao|\bclc\b"


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def note_features(note: Column) -> dict[str, Column]:
    """Doubled subject, greatest preference, campus, sex and whether a note says something else (the newer notes' form)."""
    text = F.coalesce(note, F.lit(""))
    low = F.lower(text)
    named = F.coalesce(*[F.when(low.contains(s.lower()), s) for s in SUBJECTS], F.lit(NO_SUBJECT))
    out = {
        "doubled": F.when(fn.contains_any(text, DOUBLED), named),
        "most_wanted": _found(text, WANTED, 1).try_cast("int"),
        "campus": F.nullif(F.trim(_found(text, CAMPUS, 1)), F.lit("")),
        "sex": F.when(low.contains("nam") & ~low.contains("nữ"), MALE).when(low.contains("nữ") & ~low.contains("nam"), FEMALE),
    }
    return out | {"review": (text != "") & F.coalesce(*[c.cast("string") for c in out.values()]).isNull()}


def old_note_features(note: Column) -> dict[str, Column]:
    """Weighted subject and its factor, sex, whether of high quality and whether a note says something else (the older notes' form)."""
    text = F.coalesce(note, F.lit(""))
    low = F.lower(text)
    girls, boys = low.rlike(GIRLS), low.rlike(BOYS)
    out = {
        "subject": _found(text, WEIGHT, 1),
        "factor": as_number(_found(text, WEIGHT, 2)),
        "sex": F.when(girls & boys, BOTH).when(girls, FEMALE).when(boys, MALE),
    }
    quality = low.rlike(QUALITY)
    nothing = F.coalesce(*[c.cast("string") for c in out.values()]).isNull() & ~quality
    return out | {"quality": quality, "review": (text != "") & nothing}


def institution(name: Column, code: Column) -> Column:
    """A folded name without the words for university and with one form of the city; the code if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(fn.slug(F.coalesce(name, F.lit(""))), r"\btruong\b", " "), r"\bdai hoc\b", " ")
    out = F.regexp_replace(F.replace(out, F.lit("thanh pho ho chi minh"), F.lit("tphcm")), r"\btp hcm\b", "tphcm")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit("")), code)


# Regions and provinces of schools by code; parts of names that tell them; the region of all others.
NORTH, CENTRE, SOUTH = "Miền Bắc", "Miền Trung - Tây Nguyên", "Miền Nam"
SCHOOLS = {
    "TMU": (NORTH, "Hà Nội"), "HCS": (SOUTH, "TP. Hồ Chí Minh"), "TDH": (NORTH, "Hà Nội"), "HVC": (SOUTH, "TP. Hồ Chí Minh"),
    "NHB": (NORTH, "Bắc Ninh"), "DTC": (NORTH, "Thái Nguyên"), "HGH": (NORTH, "Hà Nội"), "HIU": (SOUTH, "TP. Hồ Chí Minh"),
    "KSV": (SOUTH, "Vĩnh Long"), "PCS": (SOUTH, "TP. Hồ Chí Minh"), "NLN": (CENTRE, "Ninh Thuận"), "DDU": (NORTH, "Hà Nội"),
    "DTV": (NORTH, "Nam Định"), "VJU": (NORTH, "Hà Nội"), "UEF": (SOUTH, "TP. Hồ Chí Minh"), "HSU": (SOUTH, "TP. Hồ Chí Minh"),
    "TDB": (NORTH, "Bắc Ninh"), "HVD": (NORTH, "Hà Nội"), "SIU": (SOUTH, "TP. Hồ Chí Minh"), "DCA": (NORTH, "Hưng Yên"),
    "DHP": (NORTH, "Hải Phòng"), "DKT": (CENTRE, "Quảng Ngãi"), "XDT": (CENTRE, "Đà Nẵng"), "DTH": (NORTH, "Hà Giang"),
    "SNH": (SOUTH, "Đồng Nai"), "NVH": (NORTH, "Hà Nội"), "NVS": (SOUTH, "TP. Hồ Chí Minh"), "HHT": (NORTH, "Hà Nam"),
    "MTS": (SOUTH, "TP. Hồ Chí Minh"), "MTH": (NORTH, "Hà Nội"), "SKD": (NORTH, "Hà Nội"),
}
REGION_WORDS = [("TPHCM|Sài Gòn|Cần Thơ", SOUTH), ("Đà Nẵng|Huế|Quy Nhơn", CENTRE)]
PROVINCE_WORDS = [("TPHCM|Sài Gòn", "TP. Hồ Chí Minh"), ("Cần Thơ", "Cần Thơ"), ("Đà Nẵng", "Đà Nẵng")]


def place(code: Column, name: Column, of_code: tuple[Column, Column], of_name: tuple[Column, Column]) -> tuple[Column, Column]:
    """(region, province): by the school's code, words of its name, its code's and its name's earlier values, else a default."""
    known = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    text = F.trim(F.coalesce(name, F.lit("")))
    out = []
    for k, (words, other) in enumerate(((REGION_WORDS, NORTH), (PROVINCE_WORDS, ""))):
        manual = F.create_map(*[F.lit(x) for c, both in SCHOOLS.items() for x in (c, both[k])])
        out.append(F.coalesce(F.try_element_at(manual, known), *[F.when(text.rlike(p), v) for p, v in words], of_code[k], of_name[k], F.lit(other)))
    return out[0], out[1]


# Spellings of skills and the name that stands for each.
TECHNICAL = {
    "photoshop": "Photoshop", "adobe photoshop": "Photoshop", "pts": "Photoshop", "illustrator": "Illustrator", "adobe illustrator": "Illustrator",
    "ai": "Illustrator", "autocad": "AutoCAD", "auto cad": "AutoCAD", "cad": "AutoCAD", "excel": "Excel", "ms excel": "Excel", "word": "Word",
    "ms word": "Word", "powerpoint": "PowerPoint", "ms powerpoint": "PowerPoint", "tin học văn phòng": "Tin học văn phòng", "office": "Tin học văn phòng",
    "javascript": "JavaScript", "js": "JavaScript", "typescript": "TypeScript", "ts": "TypeScript", "python": "Python", "java": "Java", "c++": "C++",
    "c#": "C#", "php": "PHP", "sql": "SQL", "mysql": "SQL/MySQL", "html": "HTML/CSS", "html5": "HTML/CSS", "css": "HTML/CSS", "css3": "HTML/CSS",
    "react": "React", "reactjs": "React", "node": "Node.js", "nodejs": "Node.js", "vue": "Vue.js", "vuejs": "Vue.js", "after effects": "After Effects",
    "premiere": "Premiere", "figma": "Figma", "solidworks": "SolidWorks", "revit": "Revit",
}
SOFT = {
    "kỹ năng giao tiếp": "Kỹ năng giao tiếp", "giao tiếp": "Kỹ năng giao tiếp", "kỹ năng làm việc nhóm": "Làm việc nhóm", "làm việc nhóm": "Làm việc nhóm",
    "teamwork": "Làm việc nhóm", "quản lý thời gian": "Quản lý thời gian", "kỹ năng giải quyết vấn đề": "Giải quyết vấn đề",
    "giải quyết vấn đề": "Giải quyết vấn đề", "chịu áp lực": "Chịu áp lực công việc", "chịu được áp lực": "Chịu áp lực công việc",
    "chịu áp lực cao": "Chịu áp lực công việc", "trung thực": "Trung thực", "cẩn thận": "Cẩn thận", "nhanh nhẹn": "Nhanh nhẹn",
    "tinh thần trách nhiệm": "Tinh thần trách nhiệm", "trách nhiệm": "Tinh thần trách nhiệm", "kỹ năng đàm phán": "Kỹ năng đàm phán",
    "đàm phán": "Kỹ năng đàm phán", "thuyết trình": "Kỹ năng thuyết trình", "tư duy logic": "Tư duy logic", "tư duy sáng tạo": "Tư duy sáng tạo",
    "sáng tạo": "Tư duy sáng tạo",
}


def title_case(text: Column) -> Column:
    """Each run of letters with its first letter large, also after a digit or a sign."""
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{M}]+|[^\p{L}\p{M}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def skill(raw: Column, names: dict[str, str]) -> Column:
    """The name that stands for a skill, else the skill in title case."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.regexp_replace(F.lower(F.trim(raw)), r"\s+", " ")), title_case(F.trim(raw)))


COMBINATION = r"(?<![A-Z0-9])([A-D][0-9]{2})(?![A-Z0-9])"
SCORE_FIRST, SCORE_LAST = r"(?<![0-9])([0-9]{1,2}(?:[.,][0-9]{1,2})?)\s*(?:diem|d)\b", r"\bdiem\s*([0-9]{1,2}(?:[.,][0-9]{1,2})?)(?![0-9])"


def asked(question: Column, combination: Column, score: Column) -> tuple[Column, Column]:
    """(combination, score) that a question names, in either order of words; else the ones given. Scores are from 0 to 30."""
    plain = F.replace(fn.fold(question), F.lit("_"), F.lit(" "))
    said = as_number(F.coalesce(_found(plain, SCORE_FIRST, 1), _found(plain, SCORE_LAST, 1)))
    return F.coalesce(_found(F.upper(question), COMBINATION, 1), combination), F.when(said.between(0, 30), said).otherwise(score)
