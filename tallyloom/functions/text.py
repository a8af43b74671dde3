"""Text normalisation, amounts and names as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the matching rules.
GENERIC_TOKENS = (
    "AI", "API", "BILL", "BILLING", "CARD", "CO", "COM", "CORP", "CORPORATION", "INC", "JAPAN", "LLC", "LTD", "ONLINE",
    "PAYMENT", "PBC", "SERVICE", "SERVICES", "SUBSCR", "SUBSCRIPTION", "THE", "USD",
)
KNOWN_MERCHANTS = (
    ("GOOGLE_CLOUD", ("GOOGLECLOUD", "GCLOUD", "GOOGLECLOUDPLATFORM")),
    ("GOOGLE_ONE", ("GOOGLEGOOGLEON", "GOOGLEONE")),
    ("ANTHROPIC", ("ANTHROPIC", "CLAUDE")),
    ("OPENAI", ("OPENAI", "CHATGPT")),
    ("AUDIOSHAKE", ("AUDIOSHAKE",)),
    ("JETBRAINS", ("JETBRAINS",)),
    ("GITHUB", ("GITHUB",)),
    ("RAILWAY", ("RAILWAY",)),
    ("CURSOR", ("CURSOR", "ANYSPHERE")),
    ("DIFY", ("DIFY", "LANGGENIUS")),
    ("SUNO", ("SUNO",)),
    ("GROK", ("GROK", "XAI")),
    ("FIGMA", ("FIGMA",)),
)
VENDOR_WORDS = ("claude", "chatgpt", "openai", "anthropic", "google")
COMPANY_FORMS = r"PBC|INCORPORATED|INC|LLC|L\.?L\.?C|LTD|LIMITED|CORPORATION|CORP|COMPANY|CO|GMBH|S\.?R\.?O\.?|S\.?A\.?|K\.?K\.?|G\.?K\.?"
PAYEE_PREFIX = "merchant|payee|seller|vendor|billed by|paid to"
RECIPIENT_PREFIX = r"billed\s+to|bill\s+to|customer|account\s+holder|recipient|宛名|利用者名|ご使用者氏名|購入者名"
BILLING_LABELS = {"subscription": "サブスク", "metered": "従量課金 / API", "one_time": "一回払い", "other": "その他"}
FILE_TYPES = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "csv": "text/csv"}

#: Characters whose compatibility form (NFKC) is one other character, and some whose form is longer.
RANGES = ((0xA0, 0xBF), (0x2000, 0x218A), (0x2460, 0x24EB), (0x3000, 0x3001), (0xFF01, 0xFFE7))
SINGLE = {c: n for low, high in RANGES for c in map(chr, range(low, high)) if len(n := unicodedata.normalize("NFKC", c)) == 1 and n != c}
LONGER = {c: unicodedata.normalize("NFKC", c) for c in "㈱㈲㈾㏍ﬀﬁﬂﬃﬄ…™℡№㌔㌘㍉㍍㍑ⅱⅲⅣⅡⅢ"}
VOICED = "".join(chr(c) for c in range(0x304B, 0x30FE) if len(unicodedata.normalize("NFD", chr(c))) == 2)
WORD_SPACE = " "


#: Two signs that make one letter, and signs of longer forms.
FORMS = LONGER | {unicodedata.normalize("NFD", c): c for c in VOICED}
PIECES = f"(?s).[\u3099\u309a]|[{''.join(LONGER)}]|[^{''.join(LONGER)}\u3099\u309a](?![\u3099\u309a])|."


def spans(signs: str, gap: int = 32) -> str:
    """A pattern of few ranges that holds the signs, none of them ASCII, to tell at little cost where none of them is."""
    ends: list[list[str]] = []
    for c in sorted(signs):
        if ends and ord(c) - ord(ends[-1][1]) <= gap:
            ends[-1][1] = c
        else:
            ends.append([c, c])
    return "[\x80-\uffff&&[" + "".join(f"{a}-{b}" for a, b in ends) + "]]"


MAYBE_SINGLE, MAYBE_LONGER = spans("".join(SINGLE)), spans("".join(LONGER) + "\u3099\u309a")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it stands in the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def narrow(text: Column) -> Column:
    """Compatibility forms made plain: full-width signs, half-width kana with their voice marks, ligatures,
    circled and Roman numbers, squared words. Rare signs of longer forms stay."""
    forms = F.str_to_map(F.lit("\x01".join(f"{a}\x02{b}" for a, b in FORMS.items())), F.lit("\x01"), F.lit("\x02"))

    def translated(t: Column) -> Column:
        return F.when(t.rlike(MAYBE_SINGLE), F.translate(t, "".join(SINGLE), "".join(SINGLE.values()))).otherwise(t)

    def composed(p: Column) -> Column:
        pieces = F.transform(F.regexp_extract_all(p, F.lit(PIECES), F.lit(0)), lambda x: F.coalesce(F.try_element_at(forms, x), x))
        return F.when(p.rlike(MAYBE_LONGER) & p.rlike(f"[{''.join(LONGER)}\u3099\u309a]"), F.array_join(pieces, "")).otherwise(p)

    # plain signs are most texts, and translating them sign by sign costs more than to see that
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(F.octet_length(t) > F.char_length(t), let(translated(t), composed)).otherwise(t))


def normal_text(text: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(narrow(text)), r"[^\p{L}\p{N}]", "")


def identity_tokens(text: Column) -> Column:
    """Distinct runs of four or more ASCII letters and digits that are no generic words."""
    runs = F.filter(F.regexp_extract_all(F.upper(narrow(text)), F.lit("[A-Z0-9]{3,}"), F.lit(0)), lambda t: F.length(t) >= 4)
    return F.array_except(runs, F.array(*[F.lit(t) for t in GENERIC_TOKENS]))


def contains_either(a: Column, b: Column, least: int) -> Column:
    return (F.least(F.length(a), F.length(b)) >= least) & (F.contains(a, b) | F.contains(b, a))


def text_related(first: Column, second: Column) -> Column:
    a, b = normal_text(first), normal_text(second)
    same = ((a == b) & (F.length(a) >= 3)) | contains_either(a, b, 5) | F.arrays_overlap(identity_tokens(first), identity_tokens(second))
    return (a != "") & (b != "") & F.coalesce(same, F.lit(False))


def known_merchant(text: Column) -> Column:
    """The first known merchant of which a spelling is in the text, else empty."""
    normal, chain = normal_text(text), None
    for key, spellings in KNOWN_MERCHANTS:
        hit = normal.rlike("|".join(spellings))
        chain = F.when(hit, key) if chain is None else chain.when(hit, key)
    return chain.otherwise("")


def normal_plan(text: Column) -> Column:
    low = F.regexp_replace(F.lower(narrow(text)), r"(?U)\b(monthly|annual|subscription|plan)\b", " ")
    return F.trim(F.regexp_replace(low, r"[^a-z0-9ぁ-んァ-ヶ一-龠]+", " "))


def plans_related(first: Column, second: Column) -> Column:
    a, b = normal_plan(first), normal_plan(second)

    def words(x: Column) -> Column:
        return F.array_except(F.filter(F.split(x, " "), lambda t: F.length(t) >= 3), F.array(*[F.lit(w) for w in VENDOR_WORDS]))

    return (a != "") & (b != "") & ((a == b) | contains_either(a, b, 5) | F.coalesce(F.arrays_overlap(words(a), words(b)), F.lit(False)))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def amount_of(plain: Column) -> Column:
    """The number in a text of plain signs to two places, half to even; null if there is none."""
    return F.bround(F.regexp_replace(plain, r"[^0-9.\-]", "").try_cast("decimal(20,6)"), 2).cast("decimal(14,2)")


def signed_amount(text: Column) -> Column:
    return amount_of(narrow(text))


def unsigned_amount(text: Column) -> Column:
    return F.abs(signed_amount(text))


def currency_of(plain: Column) -> Column:
    """JPY, USD, EUR or GBP for their signs and names, else the first three letters; empty if fewer."""
    signs = {"¥": "JPY", "￥": "JPY", "円": "JPY", "JP¥": "JPY", "$": "USD", "US$": "USD", "USD$": "USD", "€": "EUR", "£": "GBP"}
    known = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in signs.items())))

    def read(up: Column) -> Column:
        letters = F.regexp_replace(up, "[^A-Z]", "")
        return F.coalesce(F.try_element_at(known, up), F.when(F.length(letters) >= 3, F.substring(letters, 1, 3)), F.lit(""))

    return let(F.upper(F.trim(plain)), read)


def currency_code(text: Column) -> Column:
    return currency_of(narrow(text))


def card_last4(text: Column) -> Column:
    return F.right(F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", ""), F.lit(4))


def confidence(text: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    number = F.coalesce(low.try_cast("double"), F.lit(0.0))
    return F.when(low == "high", 0.95).when(low == "medium", 0.75).when(low == "low", 0.3).otherwise(number)


def first_email(text: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", 0))


def contact_address(email: Column, username: Column) -> Column:
    return F.when(F.coalesce(email, F.lit("")) != "", email).when(F.contains(username, F.lit("@")), username).otherwise("")


def file_type(name: Column) -> Column:
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, ending), F.lit("application/octet-stream"))


def safe_part(text: Column, fallback: str = "Unknown", most: int = 80) -> Column:
    """A part of a file name: no path characters, _ for white space, runs of _ joined."""
    plain = F.regexp_replace(F.trim(narrow(text)), r"[\\/\x00\r\n\t:*?\"<>|]+", "")
    joined = F.trim(F.regexp_replace(plain, r"(?U)[\s_]+", "_"), F.lit("._- "))
    return F.substring(let(joined, lambda p: F.when(p != "", p).otherwise(F.lit(fallback))), 1, most)


def company_part(text: Column, fallback: str = "Unknown") -> Column:
    """A company's name as a part of a file name, without its legal form."""
    plain = F.regexp_replace(F.trim(narrow(text)), rf"(?i)\b(?:{COMPANY_FORMS})\b\.?", "")
    return safe_part(F.regexp_replace(plain, "[,、，]+", " "), fallback)


def user_part(last_name: Column, email: Column, username: Column) -> Column:
    """The last name, else what stands before the @ of the mail or login name."""
    named, mail = (F.when(F.coalesce(c, F.lit("")) != "", c) for c in (last_name, email))
    local = F.substring_index(F.coalesce(mail, username, F.lit("")), "@", 1)
    return F.when(safe_part(named, "") != "", safe_part(named, "")).otherwise(safe_part(local, "user"))


def party_name(text: Column, prefix: str = PAYEE_PREFIX) -> Column:
    """A name in one line without its label, cut at 160."""
    return F.substring(F.regexp_replace(one_line(narrow(text)), rf"(?i)^(?:{prefix})\s*[:：]\s*", ""), 1, 160)


def recipient_name(text: Column) -> Column:
    return party_name(text, RECIPIENT_PREFIX)


def context_text(text: Column) -> Column:
    """Lower-case words without legal forms, for comparing names with contexts."""
    low = F.regexp_replace(F.lower(narrow(text)), r"\b(?:pbc|incorporated|inc|llc|ltd|limited|corporation|corp|gmbh|s\.?r\.?o)\b", " ")
    return F.trim(F.regexp_replace(low, "[^a-z0-9ぁ-んァ-ヶ一-龠]+", " "))


def recipient_context(first_name: Column, last_name: Column, email: Column, username: Column) -> Column:
    """What a document's recipient is compared with: full name, account, and the account's readable part."""
    full = F.trim(F.concat_ws(" ", *[F.when(F.trim(c) != "", F.trim(c)) for c in (first_name, last_name)]))
    mail = F.trim(F.coalesce(F.when(email != "", email), username, F.lit("")))
    readable = F.trim(F.regexp_replace(F.substring_index(mail, "@", 1), "[._-]+", " "))
    parts = ((full, "登録氏名="), (mail, "アカウント="), (readable, "氏名候補="))
    return F.substring(F.concat_ws(" / ", *[F.when(v != "", F.concat(F.lit(label), v)) for v, label in parts]), 1, 500)


def service_name(name: Column, billing_type: Column) -> Column:
    """A service's name with the label of its billing."""
    labels = F.create_map(*[F.lit(x) for pair in BILLING_LABELS.items() for x in pair])
    return F.concat(name, F.lit("（"), F.coalesce(F.try_element_at(labels, billing_type), billing_type), F.lit("）"))


def display_filename(*names: Column) -> Column:
    """The first name that is not empty; of the last one, a path, the file's own name."""
    given = [F.when(F.coalesce(n, F.lit("")) != "", n) for n in names[:-1]]
    return F.coalesce(*given, F.element_at(F.split(names[-1], "/"), -1), F.lit(""))


def strip_memo(memo: Column, marker: str) -> Column:
    """A memo up to a marker."""
    return F.trim(F.element_at(F.split(F.coalesce(memo, F.lit("")), rf"\Q{marker}\E", 2), 1))


def append_once(memo: Column, note: str, most: int = 2000) -> Column:
    """A memo with a note behind it, unless it holds the note already."""
    held = F.coalesce(memo, F.lit(""))
    joined = F.when(held == "", F.lit(note)).otherwise(F.concat(held, F.lit("\n" + note)))
    return F.substring(F.when(F.contains(held, F.lit(note)), held).otherwise(joined), 1, most)


def amount_text(amount: Column) -> Column:
    """A whole number without places, else two places without trailing zeros."""
    return F.when(amount == F.floor(amount), amount.cast("long").cast("string")).otherwise(plain_number(amount.cast("decimal(14,2)")))


def plain_number(amount: Column) -> Column:
    """A decimal of any scale without trailing zeros behind the point; null stays null."""
    told = amount.cast("decimal(38,4)").cast("string")
    return F.regexp_replace(told, r"\.?0+$", "")


def receipt_filename(day: Column, user: Column, payee: Column, amount: Column, currency: Column, extension: Column) -> Column:
    """yymmdd_user_payee_amount_CUR.ext; .pdf without an extension; null without a day or an amount."""
    ending = F.when(F.coalesce(extension, F.lit("")) != "", F.lower(extension)).otherwise(".pdf")
    parts = [F.date_format(day, "yyMMdd"), safe_part(user, "user"), company_part(payee), amount_text(amount), safe_part(F.upper(currency), "CUR")]
    return F.when(day.isNotNull() & amount.isNotNull(), F.concat(F.concat_ws("_", *parts), ending))
