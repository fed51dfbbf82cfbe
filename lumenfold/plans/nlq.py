"""Natural-language queries to filters and residual text. Runs on the driver while a plan is built, or over a column in Arrow batches.

Rules run in a fixed order over the lower-cased query; each match marks a span that leaves the residual text. Later date
rules overwrite earlier ones. Spans are in characters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.dates import end_of_day, month_range, start_of_day, year_range

# The word lists of the rules.
PROJECT_WORDS = ["project", "projects", "repo", "repos", "repository", "repositories", "workspace", "workspaces"]
CONCEPT_WORDS = ["plan", "plans", "roadmap", "vision", "future", "prd", "rfc", "spec", "whitepaper", "guide", "design", "architecture", "notes", "meeting", "discussion", "document", "documents", "doc", "docs", "presentation", "slides", "ocr"]
SCREENSHOT_PHRASES = ["screen capture", "screenshots", "screenshot", "snip"]
QR_PHRASES = [
    (["payment qr code", "payment qr codes", "payment qr", "upi qr code", "upi qr codes", "upi qr", "upi payment qr", "crypto qr code", "crypto qr", "bitcoin qr", "payment barcode"], "qr:payment"),
    (["wifi qr code", "wifi qr codes", "wifi qr", "wi-fi qr code", "wi-fi qr codes", "wi-fi qr", "wifi barcode"], "qr:wifi"),
    (["contact qr code", "contact qr codes", "contact qr", "vcard qr code", "vcard qr", "business card qr"], "qr:contact"),
    (["url qr code", "url qr codes", "url qr", "link qr code", "link qr", "website qr code", "website qr"], "qr:url"),
    (["qr code", "qr codes", "qr", "barcode", "barcodes", "2d barcode"], "qr:*"),
]
PHOTO_PHRASES = ["photo of", "photos of", "picture of", "pictures of", "image of", "images of", "photograph of", "photographs of", "photo", "photos", "picture", "pictures", "photograph", "photographs"]
RECEIPT_WORDS = ["receipt", "receipts", "invoice", "invoices"]
VISUAL_WORDS = ["whiteboard", "whiteboards", "sketch", "drawing", "diagram", "sunset", "mountain", "beach"]
VISUAL_EXTENSIONS = ["png", "jpg", "jpeg", "webp"]
MONTHS = [("january", 1), ("jan", 1), ("february", 2), ("feb", 2), ("march", 3), ("mar", 3), ("april", 4), ("apr", 4), ("may", 5), ("june", 6), ("jun", 6), ("july", 7), ("jul", 7), ("august", 8), ("aug", 8), ("september", 9), ("sep", 9), ("sept", 9), ("october", 10), ("oct", 10), ("november", 11), ("nov", 11), ("december", 12), ("dec", 12)]
IN_TYPES = ["rust", "rs", "python", "py", "typescript", "ts", "javascript", "js", "golang", "go", "cpp", "c", "java", "sql", "pdf", "word", "excel", "ppt", "markdown", "zip", "tar"]
IN_STOPS = "the a an my this that all our their detail full english total brief general high low today yesterday production prod staging dev development test testing release memory parallel background cloud docker kubernetes practice theory realtime action terms case cases order place addition part particular advance summary fact effect use response return context progress question mind view first second third fourth quarter q1 q2 q3 q4".split()
TYPE_WORDS = [
    (["pdf", "pdfs"], ["pdf"]),
    (["docx", "doc", "word doc", "word docs", "word document", "word documents", "word"], ["docx", "doc", "rtf", "odt"]),
    (["spreadsheet", "spreadsheets", "excel", "excel sheet", "excel sheets", "xlsx", "xls", "csv"], ["xlsx", "xls", "csv", "ods"]),
    (["slide", "slides", "presentation", "presentations", "powerpoint", "ppt", "pptx"], ["pptx", "ppt", "odp"]),
    (["image", "images", "photo", "photos", "picture", "pictures", "png", "jpg", "jpeg", "svg"], ["png", "jpg", "jpeg", "webp", "svg", "gif"]),
    (["source code", "source files", "source file", "script", "scripts", "code"], ["rs", "ts", "tsx", "js", "jsx", "py", "go", "c", "cpp", "h", "hpp", "java", "sql", "sh", "ps1"]),
    (["rust", "rs file", "rs files", "rs code", "rs source"], ["rs"]),
    (["python", "py file", "py files", "py code", "py source", "python script", "python scripts"], ["py"]),
    (["typescript", "ts file", "ts files", "ts code", "ts source"], ["ts", "tsx"]),
    (["javascript", "js file", "js files", "js code", "js source"], ["js", "jsx"]),
    (["golang", "go file", "go files", "go source files", "go source file", "go source", "go code"], ["go"]),
    (["cpp", "c++", "c++ header files", "c++ header", "c header files", "c header", "c file", "c files", "c++ file", "c++ files"], ["cpp", "c", "h", "hpp"]),
    (["sql", "sql query", "sql script", "sql scripts", "sql migration scripts"], ["sql"]),
    (["markdown", "md file", "md files", "note", "notes", "text file", "txt"], ["md", "txt", "org"]),
    (["archive", "zip", "tar", "tarball", "zip file", "zip files", "tar archive"], ["zip", "tar", "gz", "7z", "rar"]),
    (["yaml", "yml", "yaml file", "yaml files"], ["yaml", "yml"]),
    (["json", "json file", "json files"], ["json"]),
    (["terraform", "tf file", "tf files", "terraform config", "terraform file"], ["tf"]),
]
FILLERS = "find that the a an i me my show get give look looking search where where's is about with for all on in from to under downloaded downloads desktop documents folder directory file files doc docs document pdf pdfs screenshot screenshots photo photos picture pictures image images containing contains having project projects repo repos repository workspace".split()
ARTICLES = ("the", "a", "an", "my")


@dataclass(frozen=True)
class ParsedQuery:
    raw: str = ""
    text: str = ""
    file_types: list[str] = field(default_factory=list)
    after: datetime | None = None
    before: datetime | None = None
    location_hints: list[str] = field(default_factory=list)
    tag_filters: list[str] = field(default_factory=list)
    is_project_query: bool = False
    is_screenshot_query: bool = False
    is_visual_query: bool = False
    use_ctime: bool = False

    @property
    def has_filters(self) -> bool:
        return bool(self.file_types or self.after or self.before or self.location_hints or self.tag_filters or self.is_project_query or self.is_screenshot_query or self.is_visual_query)


def _word(text: str) -> re.Pattern:
    """The text with no ASCII letter or digit on either side."""
    return re.compile(rf"(?<![a-z0-9A-Z]){re.escape(text)}(?![a-z0-9A-Z])")


def _bare(token: str, keep: str = "_-") -> str:
    """The token without signs at its ends."""
    a, b = 0, len(token)
    while a < b and not (token[a].isalnum() or token[a] in keep):
        a += 1
    while b > a and not (token[b - 1].isalnum() or token[b - 1] in keep):
        b -= 1
    return token[a:b]


def _digits(token: str) -> str:
    return re.sub(r"^\D+|\D+$", "", token)


def numeric_date(s: str) -> datetime | None:
    """Y-M-D, Y/M/D, M-D-Y or M/D/Y with a year of four digits."""
    parts = s.split("-") if "-" in s else s.split("/")
    if len(parts) != 3 or not all(p.isdigit() for p in parts):
        return None
    if len(parts[0]) == 4:
        y, m, d = map(int, parts)
    elif len(parts[2]) == 4:
        m, d, y = map(int, parts)
    else:
        return None
    try:
        return datetime(y, m, d, tzinfo=UTC)
    except ValueError:
        return None


class _Reading:
    """One query as the rules see it."""

    def __init__(self, raw: str, now: datetime):
        self.raw, self.low, self.now = raw, raw.lower(), now
        self.spans: list[tuple[int, int]] = []
        self.types: list[str] = []
        self.places: list[str] = []
        self.tags: list[str] = []
        self.after: datetime | None = None
        self.before: datetime | None = None
        self.project = self.screenshot = self.visual = self.ctime = False

    def has(self, words: list[str]) -> bool:
        return any(_word(w).search(self.low) for w in words)

    def first(self, phrases: list[str]) -> bool:
        """Marks the first phrase, in list order, that stands in the query."""
        for p in phrases:
            m = _word(p).search(self.low)
            if m:
                self.spans.append(m.span())
                return True
        return False

    def free(self, a: int, b: int) -> bool:
        return not any(a < e and b > s for s, e in self.spans)

    @staticmethod
    def put(into: list[str], values: list[str]) -> None:
        into += [v for v in dict.fromkeys(values) if v not in into]

    def show(self, tag: str) -> None:
        self.put(self.tags, [tag])
        self.put(self.types, VISUAL_EXTENSIONS)

    # rules, in their order
    def intents(self) -> None:
        self.project = self.has(PROJECT_WORDS)
        if not self.has(CONCEPT_WORDS) and self.first(SCREENSHOT_PHRASES):
            self.screenshot = True
            self.show("type:screenshot")
        for phrases, tag in QR_PHRASES:
            if self.first(phrases):
                self.visual = True
                self.show(tag)
                break
        if self.first(PHOTO_PHRASES):
            self.visual = True
            self.show("type:photo")
        self.visual = self.visual or self.has(RECEIPT_WORDS) or self.has(VISUAL_WORDS)

    def named_places(self) -> None:
        if self.first(["downloaded"]):
            self.ctime = True
            self.put(self.places, ["downloads"])
        if self.first(["downloads"]):
            self.put(self.places, ["downloads"])
        at = self.low.find("download folder")
        if at >= 0:
            self.put(self.places, ["downloads"])
            self.spans.append((at, at + 15))
        for name in ("desktop", "documents"):
            if self.first([name]):
                self.put(self.places, [name])

    def under(self) -> None:
        for m in re.finditer(r"(?<![a-z0-9A-Z])under \s*(\S+)", self.low):
            place = _bare(m.group(1))
            if place and place not in ARTICLES:
                self.put(self.places, [place])
                self.spans.append((m.start(), m.start() + 6 + len(m.group(1))))

    def inside(self) -> None:
        for m in re.finditer(r"(?<![a-z0-9A-Z])in (?=\s*(\S+)(?:\s+(\S+))?)", self.low):
            one, two = m.group(1), m.group(2) or ""
            a, b = _bare(one), _bare(two)
            pair = (m.start(), m.start() + 3 + len(one) + 1 + len(two))
            if a in ("folder", "directory") or b in ("folder", "directory"):
                place = b if a in ("folder", "directory") else a
                if place and place not in ARTICLES:
                    self.put(self.places, [place])
                    self.spans.append(pair)
                continue
            dated = a in dict(MONTHS) or re.fullmatch(r"[0-9]{4}", a)
            if not dated and a not in IN_TYPES and a not in IN_STOPS and len(a) >= 2:
                self.put(self.places, [a])
                self.spans.append((m.start(), m.start() + 3 + len(one)))

    def file_types(self) -> None:
        for words, exts in TYPE_WORDS:
            for w in words:
                for m in _word(w).finditer(self.low):
                    self.put(self.types, exts)
                    self.spans.append(m.span())

    def between(self, after: datetime, before: datetime, span: tuple[int, int]) -> None:
        self.after, self.before = after, before
        self.spans.append(span)

    def relative_days(self) -> None:
        now = self.now
        for word, day in (("today", now), ("yesterday", now - timedelta(days=1))):
            m = _word(word).search(self.low)
            if m:
                self.between(start_of_day(day), end_of_day(day), m.span())

    def calendar_units(self) -> None:
        now = self.now
        monday = now - timedelta(days=now.weekday())
        month_start = month_range(now.year, now.month)[0]
        this = {"week": (start_of_day(monday), end_of_day(now)), "month": (month_start, end_of_day(now)), "year": year_range(now.year)}
        earlier = month_start - timedelta(days=1)
        last = {"week": (start_of_day(monday - timedelta(days=7)), end_of_day(monday - timedelta(days=1))), "month": month_range(earlier.year, earlier.month), "year": year_range(now.year - 1)}
        for unit in ("week", "month", "year"):
            for phrases, span in ((["this"], this[unit]), (["last", "past", "previous"], last[unit])):
                for p in phrases:
                    at = self.low.find(f"{p} {unit}")
                    if at >= 0:
                        self.between(*span, (at, at + len(p) + 1 + len(unit)))
                        break

    def counted_units(self) -> None:
        for prefix in ("past ", "last "):
            for m in re.finditer(prefix + r"(?=\s*(\S+)\s+(\S+))", self.low):
                n, unit = m.group(1), m.group(2)
                if not re.fullmatch(r"[+-]?[0-9]+", n):
                    continue
                plain = re.sub(r"^[\W\d_]+", "", unit)
                for name, days in (("day", 1), ("week", 7), ("month", 30), ("year", 365)):
                    if plain.startswith(name):
                        self.between(self.now - timedelta(days=int(n) * days), self.now, (m.start(), m.start() + len(prefix) + len(n) + 1 + len(unit)))

    def open_or_closed(self, prefix: str, span: tuple[datetime, datetime]) -> None:
        self.after = span[0]
        if prefix not in ("since ", "from "):
            self.before = span[1]

    def months(self) -> None:
        for name, number in MONTHS:
            for prefix in ("in ", "during ", "from ", "since "):
                at = self.low.find(prefix + name)
                end = at + len(prefix) + len(name)
                if at < 0 or not self.free(at, end) or not _word(prefix + name).match(self.low, at):
                    continue
                year = self.now.year
                nxt = re.match(r"\s*(\S+)", self.low[end:])
                given = _digits(nxt.group(1)) if nxt else ""
                if len(given) == 4 and 1990 <= int(given) <= 2099:
                    year, end = int(given), end + nxt.end()
                elif number > self.now.month:
                    year -= 1
                self.open_or_closed(prefix, month_range(year, number))
                self.spans.append((at, end))

    def years(self) -> None:
        for prefix in ("in ", "for ", "from ", "since ", "year ", "during "):
            for m in re.finditer(re.escape(prefix) + r"(?=\s*(\S+))", self.low):
                given = _digits(m.group(1))
                span = (m.start(), m.end() + len(m.group(1)))
                if len(given) == 4 and given.isdigit() and 1990 <= int(given) <= 2099 and self.free(*span):
                    self.open_or_closed(prefix, year_range(int(given)))
                    self.spans.append(span)

    def dates(self) -> None:
        for prefix in ("after ", "since ", "before ", "until "):
            for m in re.finditer(re.escape(prefix) + r"(?=\s*(\S+))", self.low):
                day = numeric_date(_bare(m.group(1), "-/"))
                span = (m.start(), m.end() + len(m.group(1)))
                if day and self.free(*span):
                    if prefix in ("after ", "since "):
                        self.after = start_of_day(day)
                    else:
                        self.before = end_of_day(day)
                    self.spans.append(span)

    def residual(self) -> str:
        gone = set()
        for a, b in self.spans:
            gone.update(range(a, b))
        open_text = "".join(" " if i in gone else c for i, c in enumerate(self.raw))
        words = [_bare(t) for t in open_text.split()]
        more = {"snip"} if self.screenshot else set()
        return " ".join(w for w in words if w and w.lower() not in FILLERS and w.lower() not in more)


def parse_query(raw: str, now: datetime) -> ParsedQuery:
    raw = raw.strip()
    if not raw:
        return ParsedQuery()
    r = _Reading(raw, now)
    for rule in (r.intents, r.named_places, r.under, r.inside, r.file_types, r.relative_days, r.calendar_units, r.counted_units, r.months, r.years, r.dates):
        rule()
    return ParsedQuery(raw, r.residual(), r.types, r.after, r.before, r.places, r.tags, r.project, r.screenshot, r.visual, r.ctime)


PARSED = "raw string, text string, file_types array<string>, after timestamp, before timestamp, location_hints array<string>, tag_filters array<string>, is_project_query boolean, is_screenshot_query boolean, is_visual_query boolean, use_ctime boolean"


def _row(q: str, now: datetime) -> tuple:
    p = parse_query(q, now)
    return (p.raw, p.text, p.file_types, p.after and p.after.replace(tzinfo=None), p.before and p.before.replace(tzinfo=None), p.location_hints, p.tag_filters, p.is_project_query, p.is_screenshot_query, p.is_visual_query, p.use_ctime)


def parsed_table(spark, queries: list[str], now: datetime):
    """The batch form: one row per query."""
    return spark.createDataFrame([_row(q, now) for q in queries], PARSED)


def parsed(queries: DataFrame, column: str, now: datetime) -> DataFrame:
    """The same over a column: one row per distinct query; nulls have none."""
    names = [part.split()[0] for part in PARSED.split(", ")]

    def run(batches):
        for pdf in batches:
            got = pd.DataFrame([_row(q, now) for q in pdf["q"]], columns=names)
            for c in ("after", "before"):
                got[c] = pd.to_datetime(got[c])
            yield got

    return queries.select(F.col(column).alias("q")).where("q IS NOT NULL").distinct().mapInPandas(run, PARSED)
