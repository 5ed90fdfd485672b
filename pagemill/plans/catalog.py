"""What is looked for in documents: types, fields, labels and captures.

Two profiles are offered: ``standard`` and ``lite``.  Patterns are made from
labels and capture kinds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

GAP = r"[：:\s]*"
HAN = r"一-龥"
WORD = r"[\w\p{No}]"


def money(bare: bool = False) -> str:
    return r"([¥￥$]?[\d,]+\.?\d*)" if bare else r"[¥￥$]?\s*([\d,]+\.?\d*)"


def digits(low: int, high: int) -> str:
    return rf"(\d{{{low},{high}}})"


def date(year: str = "年", month: str = "月", end: str = "") -> str:
    return rf"(\d{{4}}[\s{year}/\-.]\d{{1,2}}[\s{month}/\-.]\d{{1,2}}{end})"


def run(chars: str, endings: str = "") -> str:
    return rf"([{chars}]+(?:{'|'.join(endings.split())}))" if endings else rf"([{chars}]+)"


def after(labels: str, capture: str, gap: str = GAP) -> str:
    """A capture that follows one of the labels."""
    return f"(?:{labels}){gap}{capture}"


def literals(pattern: str) -> tuple[str, ...]:
    """Texts in lower case one of which any match holds: how each label begins; none if that is not known."""
    if not pattern.startswith("(?:"):
        return ()
    out = []
    for label in pattern[3 : pattern.index(")")].split("|"):
        plain = re.match(r"[^\\.?*+\[({^$]*", label).group()
        plain = plain[:-1] if label[len(plain) : len(plain) + 1] in ("?", "*") else plain
        if not plain:
            return ()
        out.append(plain.lower())
    return tuple(out)


@dataclass(frozen=True)
class Field:
    name: str
    title: str
    title_en: str
    category: str
    patterns: tuple[str, ...]
    valid: str | None = None
    labelled: tuple[bool, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "labelled", tuple(bool(re.search("[一-鿿]", p)) for p in self.patterns))


ORG = "公司 企业 厂 商店 事务所 银行"
ORG_LITE = ORG + " 中心 Ltd Inc"
NAME = HAN + "A-Za-z"
AMOUNT = r"^[\d,.]+$"
TAX_ID = rf"({WORD}{{15,20}})"
TAX_ID_LITE = "([A-Z0-9]{15,20})"

# Fields with their titles, categories, labels and valid forms.
STANDARD = [
    Field("invoice_number", "发票号码", "Invoice Number", "identification", (after(r"发票号码|No\.?|编号", digits(8, 20)), rf"\b{digits(8, 20)}\b"), r"^\d{8,20}$"),
    Field("invoice_code", "发票代码", "Invoice Code", "identification", (after("发票代码", digits(10, 12)),), r"^\d{10,12}$"),
    Field("invoice_date", "开票日期", "Invoice Date", "temporal", (after("开票日期|日期|Date", date()), date("", ""))),
    Field("due_date", "到期日期", "Due Date", "temporal", (after("到期|截止|Due", date()),)),
    Field("seller_name", "销售方名称", "Seller Name", "entity", (after("销方|销售方|卖方|Seller", run(NAME + r"\s", ORG)), after("名称", run(HAN, "公司 企业 厂 商店")))),
    Field("buyer_name", "购买方名称", "Buyer Name", "entity", (after("购方|购买方|买方|Buyer|客户", run(NAME + r"\s", ORG)),)),
    Field("seller_tax_id", "销售方税号", "Seller Tax ID", "identification", (after("销方.*?纳税人识别号|卖方.*?税号", TAX_ID), after("纳税人识别号", TAX_ID)), rf"^{WORD}{{15,20}}$"),
    Field("buyer_tax_id", "购买方税号", "Buyer Tax ID", "identification", (after("购方.*?纳税人识别号|买方.*?税号", TAX_ID),), rf"^{WORD}{{15,20}}$"),
    Field("amount_before_tax", "金额(不含税)", "Amount (before tax)", "monetary", (after("金额|不含税|Amount", money()), after("合计|小计|Subtotal", money())), AMOUNT),
    Field("tax_amount", "税额", "Tax Amount", "monetary", (after("税额|Tax", money()),), AMOUNT),
    Field("amount_total", "价税合计", "Total Amount", "monetary", (after("价税合计|总计|总金额|合计|Total", money()), after("大写.*?", rf"[（(]{money(bare=True)}[）)]", gap="")), AMOUNT),
    Field("currency", "币种", "Currency", "metadata", (after("币种|Currency", rf"({WORD}+)"),)),
    Field("payment_method", "支付方式", "Payment Method", "metadata", (after("支付方式|付款方式|Payment", r"(\S+)"),)),
    Field("bank_name", "开户银行", "Bank Name", "entity", (after("开户行|开户银行|Bank", run(NAME, "银行 Branch")),)),
    Field("bank_account", "银行账号", "Bank Account", "identification", (after("账号|银行账号|Account", digits(10, 30)),), r"^\d{10,30}$"),
    Field("receiver_name", "收款人", "Receiver Name", "entity", (after("收款人|收款单位|Payee", run(NAME)),)),
    Field("receiver_phone", "联系电话", "Phone Number", "contact", (after("电话|联系电话|Tel|Phone", r"([\d\-\s]{10,15})"), r"(\d{3}[-\s]?\d{4}[-\s]?\d{4})"), r"^[\d\-\s]{10,15}$"),
    Field("receiver_address", "地址", "Address", "contact", (after("地址|Address", run(HAN + r"\w\p{No}\s", "路 街 道 号 室 楼 层 栋 幢 座")),)),
    Field("remarks", "备注", "Remarks", "metadata", (after("备注|Remark|Note", "(.+)"),)),
    Field("sender_name", "寄件人", "Sender Name", "entity", (after("寄件人|发件人|Sender|寄方", run(NAME)),)),
    Field("table_total", "表格合计", "Table Total", "monetary", (after("表格合计|明细合计|Item Total", money()),), AMOUNT),
    Field("document_type", "文档类型", "Document Type", "metadata", ()),
    Field("page_number", "页码", "Page Number", "metadata", (r"第\s*(\d+)\s*页", r"Page\s*(\d+)"), r"^\d+$"),
]

LITE = [
    Field("invoice_number", "发票号码", "", "identification", (after(r"发票号码|No\.?|编号", digits(8, 20)), after("号码", digits(8, 20)))),
    Field("invoice_code", "发票代码", "", "identification", (after("发票代码", digits(10, 12)),)),
    Field("invoice_date", "开票日期", "", "temporal", (after("开票日期|日期|Date|时间", date(end="日?")), date())),
    Field("seller_name", "销售方名称", "", "entity", (after("销方|销售方|卖方|Seller", run(NAME + r"\s", ORG_LITE)), after("名称", run(HAN, "公司 企业 厂 商店 银行")))),
    Field("buyer_name", "购买方名称", "", "entity", (after("购方|购买方|买方|Buyer|客户", run(NAME + r"\s", ORG_LITE)),)),
    Field("seller_tax_id", "销售方税号", "", "identification", (after("纳税人识别号|税号", TAX_ID_LITE),)),
    Field("buyer_tax_id", "购买方税号", "", "identification", (after("购方.*?纳税人识别号|买方.*?税号", TAX_ID_LITE),)),
    Field("amount_pretax", "金额(不含税)", "", "monetary", (after("金额|不含税|Amount", money()),)),
    Field("tax_amount", "税额", "", "monetary", (after("税额|Tax", money()),)),
    Field("amount_total", "价税合计", "", "monetary", (after("价税合计|总计|总金额|合计|Total", money()), r"[¥￥]\s*([\d,]+\.?\d*)")),
    Field("tax_rate", "税率", "", "monetary", (after("税率", r"(\d+\.?\d*%)"),)),
    Field("payment_method", "支付方式", "", "metadata", (after("支付方式|付款方式|Payment", r"(\S+)"),)),
    Field("bank_name", "开户银行", "", "entity", (after("开户行|开户银行|Bank", run(NAME, "银行 支行")),)),
    Field("bank_account", "银行账号", "", "identification", (after("账号|银行账号|Account", digits(10, 30)),)),
    Field("receiver_name", "收款人", "", "entity", (after("收款人|收款单位|Payee", run(NAME)),)),
    Field("phone", "联系电话", "", "contact", (after("电话|联系电话|Tel|Phone", r"([\d\-\s]{10,15})"),)),
    Field("remarks", "备注", "", "metadata", (after("备注|Remark|Note", "(.+)"),)),
    Field("goods_description", "货物/劳务名称", "", "metadata", (after("货物|劳务|商品|名称", run(NAME + r"\s")),)),
    Field("contract_number", "合同编号", "", "identification", (after("合同编号|编号", r"(\S+)"),)),
    Field("merchant_name", "商户名称", "", "entity", (after("商户|门店|店名|Merchant", run(NAME + r"\s")),)),
]

# Words that speak for a document type, types in order of precedence.
KEYWORDS = {
    "standard": {
        "invoice": ["发票", "增值税", "invoice", "税额", "纳税人识别号", "价税合计", "开票日期"],
        "receipt": ["收据", "receipt", "收款", "付款", "已收"],
        "bank_statement": ["银行流水", "对账单", "statement", "交易记录", "账户", "余额"],
        "contract": ["合同", "协议", "contract", "甲方", "乙方", "签署", "条款"],
        "quotation": ["报价", "quotation", "报价单", "单价"],
    },
    "lite": {
        "invoice": ["发票", "增值税", "invoice", "税额", "纳税人识别号", "价税合计", "开票日期", "发票号码", "发票代码", "销售方", "购买方", "税率"],
        "receipt": ["收据", "receipt", "收款", "已收", "付款", "微信支付", "支付宝", "刷卡", "现金", "商户", "消费", "小票"],
        "bank_statement": ["银行流水", "对账单", "statement", "交易记录", "账户", "余额", "借方", "贷方", "转账", "存入", "支出", "汇款"],
        "contract": ["合同", "协议", "contract", "甲方", "乙方", "签署", "条款", "履行", "违约", "约定"],
    },
}

# The fields of each document type in their order; "unknown" is for all other types.
ROUTES = {
    "standard": {
        "invoice": ["invoice_number", "invoice_code", "invoice_date", "seller_name", "buyer_name", "seller_tax_id", "buyer_tax_id", "amount_before_tax", "tax_amount", "amount_total", "receiver_name", "receiver_phone", "remarks"],
        "receipt": ["invoice_date", "amount_total", "payment_method", "receiver_name", "receiver_phone", "remarks"],
        "bank_statement": ["bank_name", "bank_account", "amount_total", "receiver_name"],
        "contract": ["seller_name", "buyer_name", "invoice_date", "amount_total", "receiver_phone", "receiver_address"],
        "unknown": ["invoice_number", "invoice_date", "amount_total", "seller_name", "buyer_name", "receiver_name", "receiver_phone", "remarks"],
    },
    "lite": {
        "invoice": ["invoice_number", "invoice_code", "invoice_date", "seller_name", "buyer_name", "seller_tax_id", "buyer_tax_id", "amount_pretax", "tax_amount", "amount_total", "tax_rate", "goods_description"],
        "receipt": ["invoice_date", "amount_total", "payment_method", "merchant_name", "goods_description"],
        "bank_statement": ["bank_name", "bank_account", "amount_total", "invoice_date", "seller_name"],
        "contract": ["contract_number", "seller_name", "buyer_name", "amount_total", "invoice_date"],
        "unknown": ["invoice_number", "invoice_date", "amount_total", "seller_name", "buyer_name", "phone", "remarks"],
    },
}

# Names of document types that users see.
TYPE_TITLES = {"invoice": "增值税发票", "receipt": "收据小票", "bank_statement": "银行流水", "contract": "合同", "unknown": "未知类型"}

# The listed templates of each profile (type, name, description, fields; None: the route).
TEMPLATES = {
    "standard": [
        ("invoice", "增值税发票", "Chinese VAT invoice extraction", ["invoice_number", "invoice_code", "invoice_date", "seller_name", "buyer_name", "amount_total"]),
        ("receipt", "收据", "Receipt extraction", ["invoice_date", "amount_total", "payment_method"]),
        ("bank_statement", "银行流水", "Bank statement extraction", ["bank_name", "bank_account", "amount_total"]),
        ("contract", "合同", "Contract extraction", ["seller_name", "buyer_name", "invoice_date", "amount_total"]),
    ],
    "lite": [
        ("invoice", "增值税发票", "自动提取发票号码、代码、日期、买卖双方、金额、税率等字段", None),
        ("receipt", "收据小票", "自动提取日期、金额、支付方式、商户名称等字段", None),
        ("bank_statement", "银行流水", "自动提取银行名称、账号、余额、统计期间等字段", None),
        ("contract", "合同", "自动提取合同编号、甲乙方、金额、签订日期等字段", None),
    ],
}


@dataclass(frozen=True)
class Scoring:
    """How a match is scored: base, label bonus, length bonus and its length, validity bonus, cap."""

    base: float
    label: float
    length: float
    least: int
    valid: float
    cap: float
    high: float
    digits: int | None


PROFILES = {"standard": STANDARD, "lite": LITE}
SCORING = {
    "standard": Scoring(0.5, 0.2, 0.1, 3, 0.2, 1.0, 0.6, None),
    "lite": Scoring(0.5, 0.25, 0.1, 2, 0.15, 0.99, 0.7, 3),
}


def fields(profile: str) -> dict[str, Field]:
    return {f.name: f for f in PROFILES[profile]}


def route(profile: str, document_type: str) -> list[str]:
    return ROUTES[profile].get(document_type, ROUTES[profile]["unknown"])


def by_category(category: str, profile: str = "standard") -> list[str]:
    return [f.name for f in PROFILES[profile] if f.category == category]
