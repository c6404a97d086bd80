"""Pattern catalogue.

Everything between a "fixed values" comment and the next blank section is data
that has to be spelled exactly so for results to be right: patterns, word
lists, thresholds and label texts.  Patterns use Java syntax (Spark's engine).
``\\p{Nd}`` stands for "any decimal digit", which is what the detection rules
mean by a digit.
"""

from __future__ import annotations

from functools import lru_cache
from importlib import resources

# --- fixed values: whitespace as text tools other than Java's engine see it --
WS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
D = r"\p{Nd}"

# --- fixed values: boundaries (CJK and punctuation count as a boundary) ------
LEFT = r"(?<![0-9A-Za-z])"
RIGHT = r"(?![0-9A-Za-z])"
LEFT_U = r"(?<![0-9A-Za-z_])"
RIGHT_U = r"(?![0-9A-Za-z_])"

# --- fixed values: the fourteen kinds, in the order they consume the text ----
_QUAD = rf"(?:25[0-5]|2[0-4]{D}|1?{D}?{D})"
_DATE = rf"(?:0[1-9]|1[0-2])(?:0[1-9]|[12]{D}|3[01])"
_PROVINCES = "京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领"
KINDS: dict[str, str] = {
    "id_card": rf"{LEFT}[1-9]{D}{{5}}(?:18|19|20){D}{{2}}{_DATE}{D}{{3}}[{D}Xx]{RIGHT}",
    "phone": rf"{LEFT}1[3-9]{D}{{9}}{RIGHT}",
    "bank_card": rf"{LEFT}{D}{{16,19}}{RIGHT}",
    "ip": rf"{LEFT}(?:{_QUAD}\.){{3}}{_QUAD}{RIGHT}",
    "email": rf"{LEFT}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{RIGHT}",
    "jwt": rf"{LEFT}eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}{RIGHT}",
    "plate": rf"{LEFT}[{_PROVINCES}][A-Z][A-Z0-9]{{5,6}}{RIGHT}",
    "passport": rf"{LEFT}[EGDSH]{D}{{8}}{RIGHT}|{LEFT}[a-zA-Z]{D}{{9}}{RIGHT}",
    "iban": rf"{LEFT_U}[A-Z]{{2}}{D}{{2}}[A-Z0-9]{{11,30}}{RIGHT_U}",
    "swift": rf"{LEFT_U}[A-Z]{{4}}[A-Z]{{2}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?{RIGHT_U}",
    "vat": rf"{LEFT_U}[A-Z]{{2}}{D}{{8,12}}{RIGHT_U}",
    "intl_phone": rf"{LEFT_U}\+[1-9]{D}{{0,3}}[{D}{WS}.\-()]{{4,18}}{D}{RIGHT_U}",
    "state_secret": (
        rf"(?:密级[{WS}]*[:：][{WS}]*(?:机密|绝密|秘密)"
        rf"|(?:[【\[［(（][{WS}]*(?:机密|绝密|秘密)[{WS}]*[】\]］)）])"
        r"|(?:★{1,3}(?:机密|绝密|秘密)))"
    ),
    "internal_mark": (
        rf"(?:(?:[【\[［(（][{WS}]*(?:内部资料|内部文件|内部文档|内参)[{WS}]*[】\]］)）])"
        rf"|(?:内部(?:资料|文件|文档|编号)[{WS}]*[:：]))"
    ),
}
KIND_ORDER = tuple(KINDS)

# A necessary condition that is far cheaper to test than the pattern itself; a
# document failing it cannot hold a hit, so the pattern is not run on it.
KIND_HINTS: dict[str, str] = {
    "id_card": rf"{D}{{17}}",
    "phone": rf"1[3-9]{D}{{9}}",
    "bank_card": rf"{D}{{16}}",
    "ip": rf"{D}\.{D}{{1,3}}\.",
    "plate": r"[^\x00-\x7f][A-Z][A-Z0-9]{5}",
    "passport": rf"[A-Za-z]{D}{{8}}",
    "iban": rf"[A-Z]{{2}}{D}{{2}}[A-Z0-9]{{11}}",
    "swift": r"[A-Z]{6}",
    "vat": rf"[A-Z]{{2}}{D}{{8}}",
}
KIND_SUBSTRINGS: dict[str, tuple[str, ...]] = {
    "email": ("@",),
    "jwt": ("eyJ",),
    "intl_phone": ("+",),
    "state_secret": ("机密", "绝密", "秘密"),
    "internal_mark": ("内部", "内参"),
}

# --- fixed values: seven kinds counted independently, with display labels ----
INDEPENDENT_LABELS = {
    "id_card": "身份证号", "phone": "手机号", "bank_card": "银行卡号", "email": "邮箱",
    "ip": "IP 地址", "plate": "车牌号", "passport": "护照号",
}

# --- fixed values: VAT prefixes (EU, EEA, CH) --------------------------------
VAT_PREFIXES = (
    "AT", "BE", "BG", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IT",
    "LT", "LU", "LV", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK", "CH", "IS", "LI",
)


@lru_cache(maxsize=1)
def country_codes() -> tuple[str, ...]:
    """ISO 3166-1 alpha-2 codes, read from the time-zone database's country table."""
    table = (resources.files("tzdata") / "zoneinfo" / "iso3166.tab").read_text(encoding="utf-8")
    return tuple(sorted(line.split("\t")[0] for line in table.splitlines() if line and not line.startswith("#")))


# --- fixed values: keep-left / keep-right masks (length, left, right, exact) --
KEEP_RULES: dict[str, tuple[int, int, int, bool]] = {
    "phone": (11, 3, 4, True),
    "id_card": (18, 6, 4, True),
    "bank_card": (12, 0, 4, False),
    "plate": (7, 2, 2, False),
    "passport": (8, 1, 2, False),
    "iban": (15, 4, 4, False),
    "swift": (8, 4, 2, False),
    "vat": (10, 2, 4, False),
}
PLACEHOLDERS = {"cn_address": "[地址]", "cn_org": "[机构]", "state_secret": "[涉密标记]", "internal_mark": "[内部]"}
TOKEN_OPEN, TOKEN_CLOSE = "⟦", "⟧"

# --- fixed values: characters that may be shown in a masked name -------------
RARE_CJK = r"[\u3400-\u4dbf\uf900-\ufaff\x{20000}-\x{2fa1f}\x{30000}-\x{323af}]"
UNCOMMON_CHAR = rf"[^0-9A-Za-z \-_@.:/\\\u4e00-\u9fff，。、；：？！“”‘’（）【】《》—…·　{WS}]"

# --- fixed values: Chinese names, addresses, organisations -------------------
COMPOUND_SURNAMES = (
    "欧阳", "司马", "上官", "诸葛", "东方", "皇甫", "令狐", "夏侯", "宇文", "慕容", "司徒", "端木", "拓跋", "轩辕",
    "公孙", "长孙", "鲜于", "耶律", "完颜", "万俟", "司空", "子车", "颛孙",
)
NAME_LABELS = ("姓名", "联系人", "客户", "经办人", "申请人", "被谈话人", "被询问人", "借款人", "担保人")
NAME_TITLES = ("先生", "女士", "同学", "老师", "经理", "总监", "主任", "教授", "工", "君")
NAME_PUNCT = rf"{WS},，.:：;；!！?？、()（）"
HAN = r"\u4e00-\u9fa5"
# The single surnames of the "Hundred Family Surnames" in its order, and common ones after them.
COMMON_SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马"
    "苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪"
    "祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁杜阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田"
    "樊胡凌霍万柯卢莫房裘缪干解应宗丁宣贲邓郁单杭洪包诸左石崔吉钮龚程嵇邢滑裴陆荣翁荀羊於惠甄曲家封芮羿储靳汲"
    "邴糜松井段富巫乌焦巴弓牧隗山谷车侯宓蓬全郗班仰秋仲伊宫宁仇栾暴甘钭厉戎祖武符刘景詹束龙叶幸司韶郜黎蓟薄印"
    "宿白怀蒲台从鄂索咸籍赖卓蔺屠蒙池乔阴郁胥能苍双闻莘党翟谭贡劳逄姬申扶堵冉宰郦雍却璩桑桂濮牛寿通边扈燕冀郏"
    "浦尚农温别庄晏柴瞿阎充慕连茹习宦艾鱼容向古易慎戈廖庚终暨居衡步都耿满弘匡国文寇广禄阙东殴殳沃利蔚越夔隆师"
    "巩厍聂晁勾敖融冷訾辛阚那简饶空曾毋沙乜养鞠须丰巢关蒯相查后荆红游竺权逯盖益桓公"
)


def name_patterns(surnames: str | None = None) -> tuple[str, str]:
    """(strong, weak) patterns for a surname plus one or two Han characters."""
    family = f"(?:{'|'.join(COMPOUND_SURNAMES)}|[{surnames or COMMON_SURNAMES}])[{HAN}]{{1,2}}"
    labels = "|".join(f"(?<={w})" for w in NAME_LABELS)
    strong = rf"(?:{labels}|(?<=[:：])){family}"
    weak = rf"(?<=[{NAME_PUNCT}]){family}(?=(?:{'|'.join(NAME_TITLES)}|[{NAME_PUNCT}]|$))"
    return strong, weak


_ADDRESS_TAIL = (
    rf"(?:[{HAN}0-9A-Za-z\-]{{1,6}}"
    r"(?:省|市|自治区|区|县|旗|盟|路|街道|街|道|大道|巷|弄|号|栋|幢|单元|室|小区|花园|广场|大厦|公寓|村|镇|乡))*"
)
CN_ADDRESS = (
    rf"[{HAN}]{{2,10}}(?:路|街|巷|道|大道|弄)[{WS}]?{D}{{1,6}}(?:号|栋|幢|单元|室)?{_ADDRESS_TAIL}"
    rf"|[{HAN}]{{2,6}}(?:省|自治区)[{HAN}]{{2,8}}(?:市|区|县|旗|盟|镇|街道|乡){_ADDRESS_TAIL}"
    rf"|[{HAN}]{{2,6}}市[{HAN}]{{2,6}}(?:区|县|旗|盟){_ADDRESS_TAIL}"
    rf"|[{HAN}]{{2,6}}特别行政区"
)
CN_ORG = (
    rf"[{HAN}]{{2,}}(?:公司|集团|银行|医院|大学|学院|学校|研究所|研究院|局|部|委员会|协会|基金会|事务所|工厂|超市|店"
    r"|分行|支行|证券|保险|基金|信托|律所|合作社|中心|平台)"
)

# --- fixed values: secrets in code-like files --------------------------------
SECRET = (
    r"(?i)(['\"]?)(?:api[_-]?key|secret|token|password|passwd|access[_-]?key|private[_-]?key|auth)['\"]?"
    rf"[{WS}]*[:=][{WS}]*('[^']{{4,}}'|\"[^\"]{{4,}}\"|[^{WS}'\"]{{4,}})"
)
SECRET_VALUE_GROUP = 2
SQL_INSERT = (
    rf"(?is)INSERT[{WS}]+INTO[{WS}]+[^{WS}(;]+(?:[{WS}]*\(([^)]*)\))?[{WS}]*VALUES[{WS}]*\(([^)]*)\)"
)
SQL_SECRET_COLUMN = r"(?i)(?:passwd|password|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth)"

# --- fixed values: file extensions -------------------------------------------
CODE_EXT = (".py", ".js", ".ts", ".go", ".java", ".c", ".cpp", ".rb", ".php", ".yml", ".yaml", ".toml", ".env",
            ".ini", ".sh", ".sql")
SECRET_EXT = CODE_EXT + (".html", ".htm", ".csv", ".json")
TEXT_EXT = (".txt", ".md", ".csv", ".tsv", ".json", ".log", ".xml", ".html", ".htm", ".rst", ".eml")
EXTRACT_EXT = (".docx", ".xlsx", ".pptx", ".pdf", ".db")
IMAGE_EXT = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp", ".heic", ".heif")
MEDIA_EXT: dict[str, tuple[str, ...]] = {
    "transcript": (".wav", ".mp3", ".m4a", ".aac", ".flac", ".ogg", ".oga", ".opus", ".wma", ".aiff", ".aif", ".caf"),
    "video": (".mp4", ".mov", ".mkv", ".avi", ".webm", ".flv", ".wmv", ".m4v", ".ts"),
    "ocr": IMAGE_EXT + (".pdf",),
    "doc_extract": (".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".epub", ".odt", ".rtf"),
}

# --- fixed values: advice on data that should be cleaned first ---------------
MESSY: dict[str, str] = {
    "messy_phone_sep": rf"{LEFT}(?:\+?86[-{WS}]?)?1[3-9]{D}[-{WS}]{D}{{3,4}}[-{WS}]{D}{{3,4}}(?!{D})",
    "messy_phone_short": rf"{LEFT}1[3-9]{D}{{8}}{RIGHT}",
    "messy_id15": rf"{LEFT}[1-9]{D}{{5}}{D}{{2}}{_DATE}{D}{{3}}{RIGHT}",
    "messy_order_like": rf"(?:订单号|订单编号|单号|流水号|计划[{WS}]*ID|编号|单据号)[:：={WS}]{{0,4}}{D}{{16,19}}",
}

# --- fixed values: name columns in tables ------------------------------------
NAME_HEADERS = (
    "name", "fullname", "buyername", "customername", "contactname", "recipientname", "consigneename",
    "shippername", "ownername", "username", "customer", "contact", "influencer", "consignee", "shipper",
    "recipient", "owner", "buyer", "client", "买家", "姓名", "联系人", "收件人", "寄件人", "客户", "用户名",
)
NAME_HEADER_EXCLUDE = ("phone", "address", "email", "tel", "mobile", "ip", "zip", "city", "country", "电话", "地址",
                       "邮箱", "账号")
LATIN_NAME = rf"^[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'\-]{{1,15}}(?:[{WS}]+[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'\-]{{1,15}}){{1,2}}$"

# --- fixed values: line-wise pre-check ---------------------------------------
PRECHECK: dict[str, str] = {
    "phone": rf"(?<!{D})(1[3-9]{D}{{9}})(?!{D})",
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "idcard": rf"(?<!{D})({D}{{17}}[{D}Xx]|{D}{{15}})(?!{D})",
    "bankcard": rf"(?<!{D})({D}{{16,19}})(?!{D})",
    "url": rf"https?://[^{WS}，。；、）)]+",
    "money": rf"([¥￥][{WS}]?{D}+(?:\.{D}+)?[{WS}]?(?:元|万|亿)?|人民币[{WS}]?{D}+(?:\.{D}+)?[{WS}]?(?:元|万|亿)?)",
    "address": (
        rf"(?:[\u4e00-\u9fff]{{2,10}}(?:路|街|巷|道|大道)[{WS}]?{D}{{1,6}}(?:号|栋|单元|室|楼)?"
        r"|[\u4e00-\u9fff]{2,6}(?:省|自治区)[\u4e00-\u9fff]{2,8}(?:市|区|县|镇|街道)"
        r"|[\u4e00-\u9fff]{2,6}市[\u4e00-\u9fff]{2,6}(?:区|县))"
    ),
    "name": r"([\u4e00-\u9fff]{2,3})(?=先生|女士|同志|老师)",
}
PRECHECK_LABEL = {"phone": "手机号", "email": "邮箱", "idcard": "身份证号", "bankcard": "银行卡号", "url": "网址",
                  "money": "金额", "address": "疑似地址", "name": "疑似姓名"}
PRECHECK_RISK = {"phone": "high", "email": "high", "idcard": "high", "bankcard": "high", "url": "medium",
                 "money": "medium", "address": "medium", "name": "low"}

# --- fixed values: risk tiers (two tables that disagree on purpose) ----------
HIGH_RISK = ("id_card", "phone", "bank_card", "passport", "jwt", "secret", "iban", "swift", "intl_phone", "cn_name",
             "cn_address", "cn_org", "state_secret")
MEDIUM_RISK = ("email", "plate", "ip", "vat", "internal_mark")
AUDIT_HIGH = ("id_card", "phone", "bank_card", "email", "ip", "plate", "passport", "name", "cn_name", "secret")
TIER_HIGH, TIER_MEDIUM, TIER_LOW = "高", "中", "低"

# --- fixed values: actions and warnings for inputs left unprocessed ----------
WARN_ENCRYPTED = (
    "⚠️ 严禁外传：解密密码、加密原文件、以及“已解密但未脱敏”的副本——三者均不得发送至任何外部/云端。"
    "仅在本地完成解密，再用本工具脱敏后，方可上云脱敏副本。"
)
WARN_IMAGE = (
    "⚠️ 严禁外传：原始图片/图片型PDF，以及 OCR 识别出、未经脱敏的文本——二者均不得发送至任何外部/云端。"
    "仅在本地完成 OCR 与脱敏后，方可上云脱敏副本。"
)
WARN_GENERIC = (
    "⚠️ 该文件未经处理，上云前须先本地转为文本/OCR/解密或确认不含敏感信息；原始文件与未脱敏文件均不得直接外传。"
)
SKIP_ACTIONS: dict[str, tuple[str, str | None]] = {
    "treatable": ("无需预处理", None),
    "encrypted": ("本地解密（用户提供密码，仅本地操作）", WARN_ENCRYPTED),
    "image": ("本地 rapidocr 识别为文本并落盘，提醒用户校对", WARN_IMAGE),
    "image_pdf": ("本地 rapidocr 识别为文本并落盘，提醒用户校对", WARN_IMAGE),
    "no_lib": ("安装缺失的抽取库后重跑", WARN_GENERIC),
    "error": ("人工复核：解密/确认完整性或转文本", WARN_GENERIC),
    "empty": ("人工确认是否含敏感信息（空文档/图片型）", WARN_GENERIC),
    "unsupported": ("本地转为文本，或 OCR/解密后纳入", WARN_GENERIC),
}

# --- fixed values: session leak check ----------------------------------------
OUTBOUND_HINTS = (
    "sheetagent", "read_table", "resolve_local_excel", "set_cell_range", "tencent-docs", "tencent_docs", "云表格",
    "表格云", "docs.qq.com", "send_mail", "agent_mail", "agent-mail", "SendMessage", "publish", "发布", "tencent-doc",
    "上云", "发送邮件", "邮件发送", "imagegen", "videogen", "生成图片", "生成视频", "图生视频", "文生视频", "image_gen",
    "video_gen", "image-to-video", "websearch", "WebSearch", "webfetch", "WebFetch", "summarize --mode cloud",
    "--mode cloud", "--mode hybrid",
)
RECOGNITION_HINTS = ("ocr", "transcript", "画面解读")
SEND_VERBS = ("发送", "外发", "发布", "上传", "cloud", "hybrid", "send", "mail", "邮件")
TRACE_HINTS = (
    "desensitize", "desensitiz", "desen", "脱敏", "desensitize_audit.md", "03_脱敏副本", "04_映射表", "脱敏副本",
    "desen scan", "desen run", "desen audit-log", "desen_send_audit", "confirm-raw", "confirm_raw",
    ".desensitize_keys",
)

# --- fixed values: online sources --------------------------------------------
ACCOUNT_PATTERNS: dict[str, tuple[str, ...]] = {
    "douyin": ("douyin.com/user/", "v.douyin.com/", "iesdouyin.com/"),
    "xiaohongshu": ("xiaohongshu.com/user/profile/", "xhslink.com/"),
    "bilibili": ("space.bilibili.com/", "bilibili.com/channel/", "bilibili.com/list/", "bilibili.com/medialist/",
                 "b23.tv/"),
    "youtube_channel": ("youtube.com/c/", "youtube.com/channel/", "youtube.com/@"),
    "playlist": ("/playlist", "list=", "&list="),
}
DRM_WORDS = ("drm", "encrypted", "加密", "premium", "sign in", "登录", "付费", "版权", "protected", "仅限", "订阅")
LOGIN_WORDS = ("login", "登录", "sign in", "cookies", "cookie", "认证", "unavailable", "private", "members only",
               "仅粉丝", "仅限", "permission")
