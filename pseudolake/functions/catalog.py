"""Categories and detection patterns. Users may pass catalogues of their own in the same form."""

from __future__ import annotations

from typing import NamedTuple


class Pattern(NamedTuple):
    type: str
    regex: str
    ignore_case: bool = True
    #: A cheap pattern that every text with a match has.
    needs: str = ""

    @property
    def java(self) -> str:
        """Unicode classes and boundaries, as the patterns are written for them."""
        return ("(?iuU)" if self.ignore_case else "(?U)") + self.regex

    @property
    def java_needs(self) -> str:
        """`needs`, by the same rules for digits and case, so that it is never narrower than the pattern."""
        return ("(?iuU)" if "\\d" in self.needs else "") + self.needs


# The categories, and for each the patterns that find it.
TYPES = ("PERSON", "SURNAME", "POSITION", "DEPARTMENT", "ORG", "LOC", "PRODUCT", "PASSPORT", "PHONE", "EMAIL", "WEB", "INN", "MONEY", "MISC")
NAME = r"(?:«[^»]{2,120}»|\"[^\"]{2,120}\"|[А-ЯЁA-Z][\w\-]{1,80}(?:\s+[А-ЯЁA-Z][\w\-]{1,80}){0,3})"
CATALOG = (
    Pattern("PASSPORT", r"\b(\d{4}\s*\d{6})\b", True, r"\d{4}"),
    Pattern("PASSPORT", r"(?:серия|паспорт)\s*[:\s]*\s*(\d{4})\s*(?:№|номер)?\s*[:\s]*\s*(\d{6})", True, r"\d{4}"),
    Pattern("PHONE", r"(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}", True, r"[+8]"),
    Pattern("PHONE", r"8\s*\d{3}\s*\d{3}\s*\d{2}\s*\d{2}", True, r"[+8]"),
    Pattern("PERSON", r"\b[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?\s+[А-ЯЁ]\.\s*[А-ЯЁ]\.", False, r"[А-ЯЁ]\."),
    Pattern("PERSON", r"\b[А-ЯЁ]\.[ \t]?[А-ЯЁ]\.[ \t]+[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?", False, r"[А-ЯЁ]\."),
    Pattern("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", True, "@"),
    Pattern("WEB", r"https?://[^\s<>\"')\]]+", True, "://"),
    Pattern("WEB", r"\bwww\.[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?:/[^\s<>\"')\]]*)?", True, r"(?i)www\."),
    Pattern("WEB", r"(?<![\w@.-])(?:[\w-]+\.)+(?:ru|su|com|net|org|io|info|biz|online|site|shop|tech|cloud|pro|dev|app|рф|xn--p1ai)\b", False, r"\.[a-zрx]"),
    Pattern("INN", r"\b(?:ИНН|ОГРН|КПП)\s*[:\s]*\s*(\d{10,12})\b", True, r"\d{10}"),
    Pattern("INN", r"\b(\d{10,12})\b(?=\s*(?:ИНН|ОГРН|КПП|инн))", True, r"\d{10}"),
    Pattern("MONEY", r"\b\d{1,3}(?:[ \t\u00A0]\d{3})*(?:[.,]\d+)?[ \t\u00A0]*(?:руб\w*|₽|RUB|USD|EUR|CNY|юан\w*|долл\w*|евро|¥|£|\$|€)(?!\w)", True, r"\d"),
    Pattern("MONEY", r"\b\d{1,3}(?:[ \u00A0\u2009]\d{3})+(?:[.,]\d+)?\b", True, r"\d"),
    Pattern("MONEY", r"\b\d{4,}(?:[.,]\d+)?[ \t\u00A0]*(?:руб\w*|₽|RUB|USD|EUR|CNY|юан\w*|долл\w*|евро|¥|£|\$|€)(?!\w)", True, r"\d"),
    Pattern("MONEY", r"\b\d+(?:[.,]\d+)?\s*(?:тыс|млн|млрд)\b\.?(?:\s*(?:руб\w*|₽))?", True, r"\d"),
    Pattern("MONEY", r"\$[ \t\u00A0]?\d{1,3}(?:[ \u00A0]\d{3})*(?:[.,]\d+)?\b", True, r"\d"),
    Pattern("MONEY", r"\b\d{1,3}(?:[ \u00A0]\d{3})+(?:[.,]\d+)?[ \t\u00A0]?(?:\$|€)\b", True, r"\d"),
    Pattern("MONEY", r"\b\d+(?:[.,]\d+)?[ \t\u00A0]?(?:долл\w*|евро|usd|eur)\b", True, r"\d"),
    Pattern("ORG", r"\b(?:ООО|ОАО|ЗАО|ПАО|НКО|НПФ|АО|ГК)\s+" + NAME, False, r"[А-ЯЁ]"),
    Pattern("ORG", r"\b(?:Фонд|Банк)\s+" + NAME, False, r"[А-ЯЁ]"),
)
#: Punctuation that doesn't belong to the end of a web address.
WEB_TAIL = r"[.,;:!?)\]}»\"'…]+$"
#: The lower number wins where two patterns find spans of one length.
PRIORITY = {"EMAIL": 0, "WEB": 1}
CONFIDENCE = 0.95
TOKEN = r"\[([A-Z_]+)_(\d+)\]"
SESSION_ID = r"^[A-Za-z0-9_-]{1,64}$"
TTL_HOURS = 24


def only(*types: str) -> tuple[Pattern, ...]:
    return tuple(p for p in CATALOG if p.type in types)
