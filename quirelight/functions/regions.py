"""Names of a book's regions in the headings of nine languages, as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import strip

# Headings by region and language, as patterns (accents count for nothing). A language that is missing
# has no such heading attested.
VOCABULARY = {
    "bibliography": {
        "de": (r"(?:quellen[-\s–]*und[-\s]*)?(?:sekund[äa]r|prim[äa]r|forschungs)?literatur(?:verzeichnis|nachweis)?", r"editionen(?: und [üu]bersetzungen)?", r"textausgaben", r"(?:quellen|siglen)?(?:verzeichnis)?[-\s]*bibliographie", r"bibliographie", r"bibliografie", r"quellenverzeichnis", r"quellen und literatur", r"verzeichnis der (?:zitierten |verwendeten )?literatur"),
        "en": (r"(?:select(?:ed)?\s+|primary\s+|secondary\s+|general\s+)?bibliography", r"works cited", r"list of works", r"references", r"(?:list of |primary |printed )?sources"),
        "fr": (r"bibliographie(?: s[ée]lective| g[ée]n[ée]rale)?", r"r[ée]f[ée]rences(?: bibliographiques)?", r"sources(?: et bibliographie)?"),
        "it": (r"bibliografia", r"fonti(?: e bibliografia)?", r"riferimenti bibliografici"),
        "es": (r"bibliograf[íi]a", r"obras citadas"),
        "pt": (r"bibliografia", r"refer[êe]ncias(?: bibliogr[áa]ficas)?", r"fontes(?: e bibliografia| impressas| manuscritas)?"),
        "nl": (r"bibliografie", r"literatuur(?:lijst|opgave)?", r"geraadpleegde werken"),
        "la": (r"bibliographia", r"conspectus librorum"),
        "ru": (r"библиография", r"список литературы", r"литература", r"источники(?: и литература)?"),
    },
    "index": {
        "de": (r"(?:\w+[-\s]?)?register", r"(?:namen|orts|personen|sach|stellen)verzeichnis", r"index(?: der \w+)?"),
        "en": (r"(?:general |subject |name |author |place |scriptural )?index(?:es)?", r"indices", r"index of (?:names|subjects|places|persons|passages)"),
        "fr": (r"index des(?:[\s-]+\p{L}{1,15}){1,4}", r"index(?: g[ée]n[ée]ral| nominum)?", r"table onomastique"),
        "it": (r"indice(?: dei nomi| dei luoghi| analitico| onomastico| dei manoscritti)",),
        "es": (r"[íi]ndice de(?:[\s-]+\p{L}{1,15}){1,4}", r"[íi]ndice(?: onom[áa]stico| anal[íi]tico| tem[áa]tico)"),
        "pt": (r"[íi]ndice de(?:[\s-]+\p{L}{1,15}){1,4}", r"[íi]ndice(?: onom[áa]stico| anal[íi]tico| tem[áa]tico| remissivo)"),
        "nl": (r"register(?: van \w+)?", r"zaakregister", r"namenregister"),
        "la": (r"index (?:nominum|rerum|locorum|verborum|auctorum)",),
        "ru": (r"указатель(?: имён| имен| названий)?", r"именной указатель", r"предметный указатель"),
    },
    "abbreviations": {
        "de": (r"abk[üu]rzungs(?:verzeichnis|liste)?", r"abk[üu]rzungen", r"siglen(?:verzeichnis)?", r"verzeichnis der abk[üu]rzungen"),
        "en": (r"(?:list of |table of )?abbreviations", r"sigla", r"short titles"),
        "fr": (r"abr[ée]viations(?: et sigles)?", r"liste des abr[ée]viations", r"sigles"),
        "it": (r"abbreviazioni",),
        "es": (r"siglas(?: e abreviaturas)?", r"abreviaturas?(?:[\s-]+(?:do|da|de|e)[\s-]+\p{L}{1,15}){0,2}"),
        "pt": (r"siglas(?: e abreviaturas)?", r"abreviaturas?(?:[\s-]+(?:do|da|de|e)[\s-]+\p{L}{1,15}){0,2}"),
        "nl": (r"afkortingen(?:lijst)?", r"lijst van afkortingen"),
        "la": (r"index siglorum", r"sigla"),
        "ru": (r"список сокращений", r"сокращения", r"условные обозначения"),
    },
    "contents": {
        "de": (r"inhalts(?:verzeichnis|[üu]bersicht|angabe)?", r"inhalt"),
        "en": (r"(?:table of )?contents",),
        "fr": (r"table des mati[èe]res", r"sommaire"),
        "it": (r"sommario", r"[íi]ndice(?: generale)?"),
        "es": (r"[íi]ndice(?: general)?",),
        "pt": (r"[íi]ndice(?: geral)?", r"sum[áa]rio"),
        "nl": (r"inhoud(?:sopgave)?",),
        "ru": (r"оглавление", r"содержание"),
    },
    "preface": {
        "de": (r"vorwort(?: und dank(?:sagung)?)?", r"geleitwort", r"zum geleit", r"danksagung(?:en)?", r"vorbemerkung(?:en)?"),
        "en": (r"preface", r"acknowledge?ments?", r"author's note"),
        "fr": (r"pr[ée]face", r"avant[- ]propos", r"remerciements"),
        "it": (r"prefazione", r"premessa", r"ringraziamenti"),
        "es": (r"prefacio", r"agradecimientos", r"nota (?:previa|del autor)"),
        "pt": (r"pref[áa]cio", r"agradecimentos"),
        "nl": (r"voorwoord", r"dankwoord", r"woord vooraf"),
        "ru": (r"предисловие", r"благодарности"),
    },
    "notes": {
        "de": (r"anmerkungen", r"endnoten", r"anmerkungsapparat"),
        "en": (r"notes", r"endnotes", r"reference notes"),
        "fr": (r"notes",),
        "es": (r"notas",),
        "pt": (r"notas",),
        "nl": (r"noten",),
        "la": (r"adnotationes",),
        "ru": (r"примечания", r"комментарии"),
    },
    "appendix": {
        "de": (r"anh[äa]nge?", r"anlagen?", r"beilagen?", r"tabellenanhang"),
        "en": (r"appendix(?:\s+(?:[ivxlcdm]+|\d{1,2}|[a-z]))?", r"appendices"),
        "fr": (r"annexes?", r"appendici?(?:\s+(?:[ivxlcdm]+|\d{1,2}|[a-z]\b))?"),
        "it": (r"appendici?(?:\s+(?:[ivxlcdm]+|\d{1,2}|[a-z]\b))?",),
        "es": (r"ap[ée]ndices?(?:\s+(?:[ivxlcdm]+|\d{1,2}|[a-z]\b))?", r"anexos?(?:\s+(?:[ivxlcdm]+|\d{1,2}|[a-z]\b))?"),
        "pt": (r"ap[êe]ndices?(?:\s+(?:[ivxlcdm]+|\d{1,2}|[a-z]\b))?", r"anexos?(?:\s+(?:[ivxlcdm]+|\d{1,2}|[a-z]\b))?"),
        "nl": (r"bijlagen?",),
        "ru": (r"приложения?",),
    },
}
#: Headings in capitals may go on with up to four more words.
IN_CAPITALS = {"index": r"(?:index|indice)(?:[\s-]+\p{L}{1,15}){1,4}", "bibliography": r"(?:bibliographie|bibliography|bibliografia)(?:[\s-]+\p{L}{1,15}){1,4}"}
NUMBER = r"(?:(?:§\s*)?(?:\d{1,3}|[ivxlcdm]{1,6}|[a-z])(?:\.\d{1,3})*[.)]?\s+)?"
TRAIL = r"\s*[.,:;·•∙]?\s*$"
MOST = 48

ACCENTED = [c for c in map(chr, (*range(0xC0, 0x250), *range(0x400, 0x460))) if len(d := unicodedata.normalize("NFD", c)) > 1 and not unicodedata.combining(d[0])]
_FROM, _TO = "".join(ACCENTED), "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def undiacritic(text: Column) -> Column:
    """Letters without their accents (Latin and Cyrillic), loose combining marks dropped."""
    return F.regexp_replace(F.translate(text, _FROM, _TO), r"\p{Mn}", "")


def fold(text: Column) -> Column:
    """Lower case, no accents, no invisible characters, single spaces, no stops inside words."""
    seen = F.regexp_replace(undiacritic(strip(text)), r"[\p{Cc}\p{Cf}&&[^\t\n\r]]", "")
    return F.regexp_replace(F.btrim(F.regexp_replace(F.lower(seen), r"(?U)\s+", " ")), r"(?<=\p{L})\.(?=\p{L})", "")


def _pattern(alternatives: list[str]) -> str:
    return rf"(?U)^{NUMBER}(?:{'|'.join(re.sub(r'\[(.)\1\]', r'\1', _plain(a)) for a in alternatives)}){TRAIL}"


PATTERNS = {region: _pattern([a for some in by.values() for a in some]) for region, by in VOCABULARY.items()}


def region_of_heading(line: Column) -> Column:
    """The region that a heading of up to 48 letters names; else null."""
    s = strip(line)
    folded = fold(s)
    out = None
    for region, pattern in PATTERNS.items():
        out = (F if out is None else out).when(folded.rlike(pattern), region)
    letters, capitals = F.length(F.regexp_replace(s, r"[^\p{L}]", "")), F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    shouted = (letters >= 3) & (capitals >= 0.8 * letters)
    for region, pattern in IN_CAPITALS.items():
        out = out.when(shouted & folded.rlike(rf"(?U)^{pattern}{TRAIL}"), region)
    return F.when((F.length(s) > 0) & (F.length(s) <= MOST), out)


def region_of_running_head(head: Column) -> Column:
    """The region of a head, or of what stands before its first separator."""
    s = strip(head)
    first = F.get(F.split(s, r"\s*[.:;—–|/]\s+|\s+[—–|/]\s*", 2), F.lit(0))
    return F.coalesce(region_of_heading(s), F.when((first != "") & (first != s), region_of_heading(first)))
