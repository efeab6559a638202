"""Template residue and error-page text in scanned pages.

Nothing lists the messages to look for; they are induced from the corpus:

1. ``learn``: page systems put messages where a whole page should be, so pages far shorter than the corpus' usual one
   are where their templates stand alone. Runs of up to four words of these pages are counted among short and among
   other pages, all documents, in a reading form that ignores case, accents, letters that scans confuse and numbers.
   Aligned over their records, words that stay are parts of a template, words that vary are its slots; parts that
   newspapers use as well are told by their share of the other pages and left out.
2. ``sites``: every text is searched for these parts with one automaton, for names in the wrappers of template
   languages (slots that still hold their variable's name), and for status lines and "lorem ipsum". A stretch of parts
   of ``SIGNS`` letters or more is a message.
3. ``residue``: a site counts if it is a message, a seed or a name in an unmistakable wrapper. Brackets that print also
   uses count only with a name that such wrappers hold elsewhere in the corpus, or one in the form of an identifier.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 4  # longest run of words that is a part of a template
SIGNS = 12  # letters of a stretch of parts that make a message
LEAST = 8  # letters of a part
SITES = "doc_id long, kind string, cue string, slot string, before string, after string"

# Names of HTTP status codes, and the usual filler. With numbers as one sign they are seeds of their own.
STATUS = {
    400: "bad request", 401: "unauthorized", 403: "forbidden", 404: "not found", 408: "request timeout", 410: "gone", 429: "too many requests",
    500: "internal server error", 502: "bad gateway", 503: "service unavailable", 504: "gateway timeout",
}
FILLER = "lorem ipsum"

# Letters that scans confuse get the same signs: c e, t f, n u, h b li, d cl, m rn in, w vv, y v, g q, i l 1, o 0, s 5.
_SAME = {"c": "e", "f": "t", "u": "n", "h": "ii", "b": "ii", "l": "i", "1": "i", "d": "ei", "m": "in", "w": "vv", "y": "v", "q": "g", "0": "o", "5": "s", "ſ": "s", "ß": "ss", "æ": "ae", "œ": "oe", "ﬁ": "ti", "ﬂ": "ti"}


class _Reading(dict):
    """str.translate table to the reading form, filled as characters occur."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code)).casefold():
            if c in _SAME:
                out += _SAME[c]
            elif c.isalnum():
                out += c
        self[code] = out
        return out


_TABLE = _Reading()


def reading(text: str) -> str:
    return text.translate(_TABLE).replace("rn", "in")


@lru_cache(1 << 18)
def _token(word: str) -> tuple[str, str, bool]:
    """(sign, word, stop): a word's reading form, one sign for words with figures in them, empty for punctuation; and
    whether it ends a sentence."""
    form = reading(word)
    return "#" if any(c in "2346789" for c in form) else form, word, word[-1] in ".!?" and len(word) > 2


_NAME = r"[^\W\d_](?:[\w.\- ]{0,60}\w)?"
_HARD = re.compile(
    rf"\{{\{{\{{?\s*({_NAME})|[$#]\{{\s*({_NAME})|\{{%\s*block\s*({_NAME})?|<%=?\s*({_NAME})|%\(({_NAME})|%%\s*({_NAME})\s*%|@@\s*({_NAME})|\[\[\s*({_NAME})|<!-+\s*({_NAME})"
)
_SOFT = re.compile(rf"<({_NAME})\s*>|«\s?({_NAME})\s?»|\$({_NAME})\$|\[({_NAME})\]|(?<!_)__({_NAME})__(?!_)|\{{\s?({_NAME})\s?\}}")
_OPEN = re.compile(r"[{<«$\[]\s?(?:INSERT|insert)\b|\{\{|\{%|\$\{|#\{|<%=|%\(|%%|@@|\[\[|<!-")
_IDENTIFIER = re.compile(r"(?:[a-z]+[A-Z][A-Za-z]*|[^\W_]+(?:_[^\W_]+)+|[a-z]+(?:\.[a-z]+)+|(?:INSERT|insert)[ _].*)")
_CODES = re.compile("|".join(str(c).replace("0", "[0oO]").replace("1", "[1lI]").replace("5", "[5sS]") for c in STATUS))
_ENTITY = re.compile(r"&([l1iIgq])[tf];")
_BREAK = re.compile(r"[-­¬]\r?\n\s*")


def _segments(text: str) -> list[list[tuple[str, str, bool]]]:
    """The text as runs of tokens, cut at the ends of sentences and where lines change from capitals to others: a heading
    isn't the start of what follows it. Words broken over lines are joined first."""
    runs, now, last = [], [], None
    for line in _BREAK.sub("", text).split("\n"):
        words = line.split()
        if not words:
            continue
        capitals = line.isupper()
        if capitals != last:
            if now:
                runs.append(now)
                now = []
            last = capitals
        for token in map(_token, words):
            if token[0]:
                now.append(token)
            if token[2] and now:
                runs.append(now)
                now = []
    return runs + [now] if now else runs


def _stream(run: list[tuple[str, str, bool]]) -> str:
    return "".join([t[0] for t in run])


def _parts(text: str) -> set[tuple[str, ...]]:
    found = set()
    for run in _segments(text):
        signs = [t[0] for t in run]
        for n in range(1, WORDS + 1):
            found.update(p for i in range(len(signs) - n + 1) if sum(map(len, p := tuple(signs[i : i + n]))) >= LEAST)
    return found


@dataclass
class Parts:
    """Induced parts of message templates, as runs of signs without spaces, with the records that show them."""

    short: int = 0  # short pages of the corpus
    other: int = 0
    found: dict[str, tuple[int, int]] = field(default_factory=dict)  # part: (short pages, other pages)


def _rows(columns: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, columns)], [n for n, _ in columns])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = Counter(p for text in batch.column("text").to_pylist() for p in _parts(text))
        yield _rows([("part", pa.string()), ("n", pa.int64())], [(" ".join(p), c) for p, c in n.items()])


def _automaton(parts) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for p in parts or ["\0"]:  # it needs a word
        found.add_word(p, p)
    found.make_automaton()
    return found


def _count(parts: list[str]):
    """How many short and other documents hold each part, added up inside the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _automaton(parts)
        n: Counter = Counter()
        for batch in batches:
            for text, short in zip(batch.column("text").to_pylist(), batch.column("short").to_pylist()):
                stream = "|".join(map(_stream, _segments(text)))
                n.update((p, short) for p in {p for _, p in search.iter(stream)})
        yield _rows([("part", pa.string()), ("short", pa.bool_()), ("n", pa.int64())], [(*k, c) for k, c in n.items()])

    return run


def learn(docs: DataFrame, length: float = 0.25, support: float = 0.0005, lift: float = 10.0, common: float = 2.0) -> Parts:
    """Parts of message templates of a corpus (doc_id, text).

    A page is short if it has fewer than ``length`` times the characters of the median page. A part stands in at least
    ``support`` of all short pages (a single word in two or more of them at that) and in two documents or more, and its
    share of the short pages is at least ``lift`` times that of the others. Parts that hold a run of words which is less
    than ``common`` times as frequent on short pages, such as headings, are newspaper text. The support bounds the parts
    that leave Spark: WORDS times the words of a short page over ``support``, whatever the number of documents. Repeated
    documents count as often as they stand. A phrase that a message shares with print is told by its frequency only, so one
    printed in a few pages is still a part. A corpus without short pages, or of short pages only, has no parts.
    """
    pages = docs.select("text").withColumn("letters", F.length(F.btrim("text", F.lit(" \t\r\n\v\f")))).filter("letters > 0")
    median = pages.agg(F.percentile_approx("letters", 0.5)).first()[0]
    pages = pages.select("text", (F.col("letters") < length * (median or 0)).alias("short"))
    n_short, n_other = pages.agg(F.count(F.when(F.col("short"), 1)), F.count(F.when(~F.col("short"), 1))).first()
    got = Parts(n_short, n_other)
    if not n_short or not n_other:
        return got
    least = support * n_short
    rows = pages.filter("short").select("text").mapInArrow(_candidates, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    rows = rows.filter((F.col("n") >= least) & ((F.col("n") >= 2) | F.contains("part", F.lit(" "))))
    runs = [tuple(r["part"].split(" ")) for r in rows.toLocalIterator()]
    if not runs:
        return got
    joined = sorted({"".join(r) for r in runs})
    counted: dict[str, list[int]] = {p: [0, 0] for p in joined}
    for r in pages.mapInArrow(_count(joined), "part string, short boolean, n long").groupBy("part", "short").agg(F.sum("n").alias("n")).toLocalIterator():
        counted[r["part"]][not r["short"]] = r["n"]
    rise = {p: s * n_other / (max(o, 1) * n_short) for p, (s, o) in counted.items()}
    for run in runs:
        inner = ("".join(run[i:j]) for i in range(len(run)) for j in range(i + 1, len(run) + 1))
        part = "".join(run)
        if sum(counted[part]) >= 2 and rise[part] >= lift and all(rise.get(x, lift) >= common for x in inner):
            got.found[part] = (counted[part][0], counted[part][1])
    return got


def _messages(runs: list[list[tuple[str, str, bool]]], search) -> Iterator[tuple[list[tuple[str, str, bool]], list[bool]]]:
    """Segments that hold a stretch of parts of ``SIGNS`` or more, and which of their words the stretches cover."""
    for run in runs:
        covered: list[list[int]] = []
        for end, part in search.iter(_stream(run)):
            start = end + 1 - len(part)
            while covered and covered[-1][1] >= start:
                start = min(start, covered.pop()[0])
            covered.append([start, end + 1])
        covered = [c for c in covered if c[1] - c[0] >= SIGNS]
        if covered:
            at, hit = 0, []
            for sign, _, _ in run:
                hit.append(any(a < at + len(sign) and at < b for a, b in covered))
                at += len(sign)
            yield run, hit


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    left, right = text[max(0, start - 60) : start].split(), text[end : end + 60].split()
    return " ".join(left[-3:]), " ".join(right[:3])


def _stretches(run: list[tuple[str, str, bool]], hit: list[bool]) -> Iterator[tuple[str, str, str]]:
    """(words, three before, three after) of the covered stretches of a segment."""
    words = [t[1] for t in run]
    i = 0
    while i < len(hit):
        j = i
        while j < len(hit) and hit[j]:
            j += 1
        if j > i:
            yield " ".join(words[i:j]), " ".join(words[max(0, i - 3) : i]), " ".join(words[j : j + 3])
        i = max(j, i + 1)


_FIRST = reading(FILLER)


def _seeds() -> list[tuple[str, str, str]]:
    return [("status", f"{code} {name}", reading(f"{code} {name}")) for code, name in STATUS.items()] + [("filler", FILLER, reading(FILLER))]


def _sites(parts: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _automaton(parts)
        seeds = _automaton([s for _, _, s in _seeds()])
        named = {s: (kind, cue) for kind, cue, s in _seeds()}
        for batch in batches:
            rows: list[tuple] = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not raw or raw.isspace():
                    continue
                text = _BREAK.sub("", raw)
                runs = _segments(raw)
                for segment, hit in _messages(runs, search):
                    rows += [(doc, "message", cue, None, before, after) for cue, before, after in _stretches(segment, hit)]
                if _CODES.search(text) or any(_FIRST in _stream(run) for run in runs):
                    form = reading(text)
                    rows += [(doc, *named[s], None, form[max(0, end - len(s) - 13) : end + 1 - len(s)], form[end + 1 : end + 15]) for end, s in seeds.iter(form)]
                if "&" in text:
                    text = html.unescape(_ENTITY.sub(lambda m: "&lt;" if m[1] in "l1iI" else "&gt;", text))
                if any(c in text for c in "{<«$[%@_#"):
                    flat = re.sub(r"\s+", " ", text)
                    taken = []
                    for m in _HARD.finditer(flat):
                        taken.append(m.span())
                        name = next((g for g in m.groups() if g), "")
                        rows.append((doc, "name", m[0][:2].strip(), name, *_around(flat, m.start(), m.end())))
                    for m in _OPEN.finditer(flat):
                        if not any(a <= m.start() < b for a, b in taken):
                            rows.append((doc, "name", m[0], "", *_around(flat, m.start(), m.end())))
                    for m in _SOFT.finditer(flat):
                        name = next(g for g in m.groups() if g)
                        kind = "name" if _IDENTIFIER.fullmatch(name) else "bracket"
                        rows.append((doc, kind, m[0][0], name, *_around(flat, m.start(), m.end())))
            yield _rows([("doc_id", pa.int64()), *((c, pa.string()) for c in ("kind", "cue", "slot", "before", "after"))], rows)

    return run


def sites(docs: DataFrame, parts: Parts | None = None) -> DataFrame:
    """(doc_id, kind, cue, slot, before, after): all places that may be residue, with what stands beside them.

    ``parts`` are those of ``learn``, by default of these documents. Whole texts are read; null, empty and blank ones
    have no sites."""
    parts = learn(docs) if parts is None else parts
    return docs.select("doc_id", "text").mapInArrow(_sites(sorted(parts.found)), SITES)


def templates(docs: DataFrame, parts: Parts | None = None) -> DataFrame:
    """(template, n_docs, n_slots, n_fillings): messages of the corpus as aligned, in reading form; ``{}`` is a slot, a
    stretch of words that no part covers, and ``n_fillings`` counts what stands in the slots."""
    parts = learn(docs) if parts is None else parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _automaton(sorted(parts.found))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                for segment, hit in _messages(_segments(text), search):
                    kept: list[str] = []
                    for (sign, _, _), h in zip(segment, hit):
                        if h or not kept or kept[-1] != "{}":
                            kept.append(sign if h else "{}")
                    rows.append((doc, " ".join(kept), " ".join(t[0] for t, h in zip(segment, hit) if not h)))
            yield _rows([("doc_id", pa.int64()), ("template", pa.string()), ("filling", pa.string())], rows)

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, template string, filling string").distinct()
    n_slots = F.size(F.split("template", r"\{\}")) - 1
    return found.groupBy("template").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("filling").alias("n_fillings")).select("template", "n_docs", n_slots.alias("n_slots"), "n_fillings")


def slot_names(found: DataFrame, least: int = 2) -> DataFrame:
    """(name): all words of variable names that unmistakable wrappers hold in at least ``least`` records, in lower
    case."""
    words = F.explode(F.split(F.lower(F.regexp_replace("slot", r"([a-z])([A-Z])", "$1 $2")), r"[\s._\-]+")).alias("name")
    names = found.filter((F.col("kind") == "name") & (F.length("slot") > 0) & (F.size(F.split("slot", " ")) <= 3)).select("doc_id", words).filter(F.length("name") > 1).distinct()
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("name")


def residue(docs: DataFrame, least: int = 2, parts: Parts | None = None) -> DataFrame:
    """(doc_id, kind, cue, slot) of the sites that are residue: names never filled in, filler, messages, notices.

    Rows are distinct. A printed note in single brackets, angle quotes or dollars is residue only if all its words are
    slot names of the corpus; blanks of a coupon, rules and leader dots never are."""
    from ..session import cut

    found = cut(sites(docs, parts).distinct())
    sure = found.filter(F.col("kind") != "bracket").select("doc_id", "kind", "cue", "slot")
    maybe = found.filter(F.col("kind") == "bracket").select("doc_id", "kind", "cue", "slot").distinct()
    words = maybe.select("doc_id", "cue", "slot", F.explode(F.split(F.lower("slot"), r"[\s._\-]+")).alias("name"))
    known = words.join(slot_names(found, least).withColumn("known", F.lit(1)), "name", "left")
    named = known.groupBy("doc_id", "cue", "slot").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("k")).filter(F.col("n") == F.col("k"))
    return sure.unionByName(named.select("doc_id", F.lit("name").alias("kind"), "cue", "slot")).distinct()


def flagged(docs: DataFrame) -> DataFrame:
    """(doc_id) of the documents with residue."""
    return residue(docs).select("doc_id").distinct()


def clean(docs: DataFrame) -> DataFrame:
    """The documents without residue, all columns."""
    return docs.join(flagged(docs), "doc_id", "left_anti")


def aligned(docs: DataFrame, constant: float = 0.5) -> DataFrame:
    """(kind, cue, side, place, n_docs, n_words, word): templates as aligned at their anchors.

    ``place`` counts words away from the anchor on the left or right ``side``. ``word`` is the word that stands there
    in more than ``constant`` of the records, null where the place is a slot; ``n_words`` are its different words."""
    from ..session import cut

    found = sites(docs, Parts()).filter(F.col("kind").isin("name", "bracket"))
    left = F.reverse(F.split("before", " "))
    places = found.select("doc_id", "kind", "cue", F.lit("left").alias("side"), F.posexplode(left).alias("place", "word")).unionByName(
        found.select("doc_id", "kind", "cue", F.lit("right").alias("side"), F.posexplode(F.split("after", " ")).alias("place", "word"))
    )
    counts = cut(places.groupBy("kind", "cue", "side", "place", "word").agg(F.count_distinct("doc_id").alias("n")))
    per = counts.groupBy("kind", "cue", "side", "place").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_words"), F.max(F.struct("n", "word")).alias("top"))
    return per.select("kind", "cue", "side", "place", "n_docs", "n_words", F.when(F.col("top.n") > constant * F.col("n_docs"), F.col("top.word")).alias("word"))
