"""Vocabularies and patterns that decide results."""

# Field extraction.
AMOUNT_KEYWORDS = ["¥", "￥", "$", "金额", "总价", "合计", "总额", "总计", "费用", "价款", "报酬", "单价", "违约金", "赔偿金", "保证金", "押金", "罚金", "包干费用", "合同总价", "合同总额", "合同费用", "含税", "不含税", "增值税", "元"]
DATE_PATTERNS = [r"\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}[日号]?", r"\d{4}年\s*\d{1,2}月\s*\d{1,2}日", r"\d{1,2}[-/.月]\d{1,2}[日号]?\s*\d{4}年?", r"\d{4}年\d{1,2}月\d{1,2}日"]
AMOUNT_WORDS = "[零壹贰叁肆伍陆柒捌玖拾佰仟万亿圆元整角分]+"
NUMBER = r"\d+(?:,\d{3})*(?:\.\d+)?"
#: What stands before an amount, in order of precision, and whether the unit stands behind it. LABEL is any keyword.
AMOUNT_SHAPES = [(r"LABEL\s*为\s*[¥＄$]?\s*", True), (r"(人民币)\s*", True), (r"(RMB)\s*", False), (r"LABEL\s*", True), (r"([¥＄$])\s*", False), (r"LABEL\s*[:：]?\s+", False)]
#: What stands in every head of a shape, as text; of the last shape as a pattern.
AMOUNT_NEEDS = ["为", "人民币", "RMB", "", "", r"\s\z"]
#: All that these shapes have between a label and the number.
AMOUNT_SIGNS = " \t\n\v\f\r为¥＄$:："
SYMBOL_SHAPE, SYMBOL_LABELS = 4, [r"([一-鿿]*(?:费用|金额|总价|总额|合计|包干)[一-鿿]*)$", r"([一-鿿]+)$"]
PERCENTAGE = r"(\d+(?:\.\d+)?)%"
PARTY = r"[甲乙丙丁戊己庚辛壬癸\d]+方"
ORGANISATION = r"[^\n\r]{4,40}(?:公司|中心|事务所|工作室|集团|厂|处|局|行|会|院|所|部|站)"
PARTY_SHAPES = [rf"({PARTY})\s*[）)]?\s*[:：]\s*({ORGANISATION})", rf"({PARTY})[（(]\s*({ORGANISATION})[）)]", rf"({PARTY})\s+({ORGANISATION})"]
#: What stands in every find of these shapes.
PARTY_NEEDS = [r"方\s*[）)]?\s*[:：]", "方[（(]", r"方\s"]
CONTRACT_NUMBERS = [r"合同编号\s*[:：]\s*([A-Za-z0-9\-_./]+)", r"(?i)No\.?\s*[:：]?\s*([A-Za-z0-9\-_./]+)", r"(?:^|[\n\r。，,;；])\s*编号\s*[:：]\s*([A-Za-z0-9\-_./]{4,})"]
CLAUSE = r"(第[一二三四五六七八九十百千万\d]+[条章节])\s*([^\n\r,，。.;；]{1,50})"
CONTACT_MOBILE, CONTACT_LANDLINE, CONTACT_EMAIL = r"(?<!\d)(1[3-9]\d{9})(?!\d)", r"(?:\(\d{3,4}\)\s*)?(?<!\d)(\d{3,4}[- ]\d{7,8})(?!\d)", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
LEGAL_TERMS = {
    "违约责任": ["违约责任", "违约条款", "违约处理", "违约处罚"],
    "争议解决": ["争议解决", "纠纷解决", "争议处理", "争议管辖", "仲裁条款", "仲裁"],
    "保密条款": ["保密条款", "保密义务", "保密协议", "保密", "商业机密"],
    "知识产权": ["知识产权", "专利权", "商标权", "著作权", "版权"],
    "不可抗力": ["不可抗力", "免责条款", "免责事由"],
    "付款方式": ["付款方式", "支付方式", "付款条件", "付款时间", "付款期限", "付款安排"],
    "交付验收": ["交付验收", "验收标准", "验收条件", "验收程序", "验收方式", "交货验收"],
}
DURATION_TERMS = {"工期": ["工期", "施工工期", "合同工期"], "期限": ["期限", "合同期限", "服务期限", "有效期限", "履行期限"], "有效期": ["有效期", "合同有效期", "质保期", "质量保证期", "保修期"]}

# Matching.
RELATIVE_TOLERANCE, ABSOLUTE_TOLERANCE, PERCENT_TOLERANCE = 0.00001, 0.01, 0.001
AMOUNT_CONTEXT = ["费用", "金额", "总计", "包干", "违约", "赔偿"]
FAMILY_LABELS = {"numbers": "数字", "dates": "日期", "amounts_words": "大写金额", "amounts_digits": "金额数字", "percentages": "百分比"}
FAMILY_RISK = {"amounts_words": "high", "amounts_digits": "high", "dates": "medium", "numbers": "medium", "percentages": "low"}

# Text differences.
DIFF_LEGAL_WORDS = ["违约金", "赔偿金", "保证金", "押金", "罚金", "甲方", "乙方", "丙方", "解除", "终止", "无效", "撤销", "争议", "仲裁", "诉讼", "管辖", "保密", "知识产权", "违约责任", "不可抗力", "不可抗力事件", "生效", "履行", "交付", "验收"]

# Sheets.
FINANCIAL_HEADERS = ["金额", "价格", "费用", "总价", "合计", "总额", "总计", "单价", "价款", "报酬", "违约金", "赔偿金", "保证金", "押金", "罚金", "含税", "不含税", "增值税", "税额", "成本", "利润", "收入", "支出", "预算", "结算", "应收", "应付", "实付", "实收", "余额"]
DATE_HEADERS = ["日期", "时间", "年月", "签订日", "生效日", "到期日", "起始日", "终止日", "创建时间", "修改时间", "更新时间", "开始日期", "结束日期", "截止日期", "交付日期"]
ID_HEADERS = ["编号", "序号", "ID", "id", "No", "no", "NO", "合同号", "合同编号", "订单号", "订单编号", "项目编号", "项目号", "代码", "编码", "身份证", "工号", "学号", "卡号", "账号"]
KEY_UNIQUENESS, FUZZY_HEADER, MOVED_ROW = 0.8, 0.7, 0.6

# Recognised tokens.
INDUSTRY_KEYWORDS = {
    "general": ["甲方", "乙方", "合同编号", "签订日期", "合同金额", "有效期", "地址", "联系人", "电话", "传真"],
    "construction": ["工程名称", "施工单位", "监理单位", "工期", "质量标准", "验收标准", "安全文明施工费", "暂列金额"],
    "leasing": ["出租方", "承租方", "租赁物", "租赁期限", "租金", "押金", "违约金", "提前解约"],
    "procurement": ["供方", "需方", "产品名称", "规格型号", "数量", "单价", "交货期", "质保期"],
    "labor": ["用人单位", "劳动者", "劳动期限", "试用期", "岗位", "工资", "社保", "解除条件"],
}
BOOST_AMOUNT_WORDS = ["¥", "￥", "$", "元", "万", "千元", "百元", "角", "分"]
BOOST_AMOUNT = r"[¥￥$]\s*\d|[\d,]+\.\d{2}\s*元|\d+万"
BOOST_DATE = r"\d{4}\s*年|\d{1,2}\s*月|\d{1,2}\s*日|\d{4}[-/]\d{1,2}[-/]\d{1,2}"
BOOST_NUMBER = r"(?:No\.|编号|第\s*\d+\s*号|字\s*第\s*\d+)"
BOOST_PERCENT = r"\d+\.?\d*\s*[%％]|百分之"

# Masking and sanitising.
MASK_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
MASK_SEAL = r"\b[A-Za-z]+\d{3,}[A-Za-z]+\d+\b"
MASK_ID_CARD = r"[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]"
MASK_BANK = r"\b\d{16,19}\b"
MASK_MOBILE = r"1[3-9]\d{9}"
MASK_LANDLINE = r"\b\d{3,4}[\-\s]?\d{7,8}(?:\s*(?:转|分机)\s*\d{1,6})?\b"
ZERO_WIDTH = r"[\u200B-\u200F\uFEFF\u00AD\u2060-\u2064\u2066-\u206F]"
MAGIC_BYTES = {"25504446": [".pdf"], "504B0304": [".docx", ".zip", ".xlsx"], "D0CF11E0": [".doc", ".xls", ".ppt"], "EFBBBF": [".txt"], "89504E47": [".png"], "FFD8FF": [".jpg", ".jpeg"], "424D": [".bmp"], "49492A00": [".tiff", ".tif"], "4D4D002A": [".tiff", ".tif"], "52494646": [".webp"]}
IMAGE_TYPES = [".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif", ".webp"]
UPLOAD_TYPES = [".pdf", ".docx", ".xlsx", *IMAGE_TYPES]
MAX_UPLOAD_MB = 50
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]
RATE_PER_MINUTE, RATE_BURST = 30, 5

# Post-correction of recognised text. Look-alike characters stand in pairs.
LOOK_ALIKES = ["已己", "未末", "干千", "土士", "曰日", "人入", "大太", "夭天", "乌鸟", "免兔", "酒洒", "候侯", "拨拔", "刺剌", "崇祟", "盲育", "汩汨", "茶荼", "赢羸", "辨辩", "粱梁", "栗粟", "陪赔", "竞竟", "历厉", "密蜜", "板扳", "模摸", "稿搞", "码玛", "狠狼", "根跟", "性姓", "纪记", "徒徙", "裁栽", "载戴"]
PHRASE_FIXES = {"己经": "已经", "未来": "未来", "千部": "干部", "土兵": "士兵", "大阳": "太阳", "鸟云": "乌云", "免子": "兔子", "酒水": "洒水", "拔款": "拨款", "侯选": "候选", "祟高": "崇高", "育目": "盲目", "荼叶": "茶叶", "羸利": "盈利", "辩别": "辨别", "梁食": "粮食", "粟米": "粟米", "赔偿": "赔偿", "竟争": "竞争", "厉史": "历史", "蜜封": "密封", "扳权": "版权", "摸型": "模型", "搞件": "稿件", "玛头": "码头", "狼心": "狠心", "跟本": "根本", "姓质": "性质", "记律": "纪律", "徙弟": "徒弟", "栽判": "裁判", "戴重": "载重"}
CORRECTION_WORDS = ["元", "万", "千", "百", "角", "分", "¥", "￥", "$"]

# Labels.
RISK_LABELS = {"high": "高风险", "medium": "中风险", "low": "低风险"}
RISK_COLOURS = {"high": "D32F2F", "medium": "F57C00", "low": "1976D2"}
DIRECTION_LABELS = {"missing_in_pdf": "PDF 缺失", "extra_in_pdf": "PDF 多出"}
ROLE_PERMISSIONS = {"admin": ["compare", "export", "manage_keys", "manage_profiles", "view_audit"], "analyst": ["compare", "export", "manage_profiles"], "viewer": []}
#: A cell's text that stands for the number zero.
ZERO = r"^-?0+(?:\.0*)?$"
#: How much a token must resemble a keyword.
SIMILAR_KEYWORD = 0.7
