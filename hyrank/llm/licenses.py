"""License scan: ordered signature rules behind a keyword prefilter.

A rule is (label, priority, keyword, pattern, confidence). ``license_texts`` lists signature sentences
of licence texts, written one by one; beside them stand templates over families of licences (tag, notice,
name with version, name, link). One automaton finds the keywords
of a lower-cased text; only rules whose keyword occurs are run. Detections
are taken by priority, then length, then place; one that lies inside an
already taken interval is suppressed.

Beside them stand base phrases, matched on whole words anywhere (words are
runs of letters, digits and non-ASCII bytes); these are never suppressed.

One map over the documents, whole texts, no shuffle; texts of any length are
matched whole, one at a time. Null text: empty, no words, no labels, score 0.
An empty table gives an empty one. Of detections that tie in priority, length and place the rule listed
first is kept. Equal rows get equal results. A column called like the result is replaced, others pass through.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyrank.llm import textbytes as tb
from hyrank.llm.common import table
from hyrank.llm.license_texts import NOTICES

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def _pattern(p: str) -> re.Pattern:
    """Texts are matched as Latin-1 over UTF-8 bytes, so only ASCII is a word character or a space."""
    return re.compile(p, re.A)


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern
    confidence: float


# Public licence names: label, pattern of the name, keyword, versions.
FAMILIES = [
    ("gpl", r"gnu\s+general\s+public\s+licen[cs]e", "general public licen", ("1", "2", "3")),
    ("lgpl", r"gnu\s+(?:lesser|library)\s+general\s+public\s+licen[cs]e", "general public licen", ("2", "2.1", "3")),
    ("agpl", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[cs]e", "affero", ("1", "3")),
    ("gfdl", r"gnu\s+free\s+documentation\s+licen[cs]e", "free documentation", ("1.1", "1.2", "1.3")),
    ("apache", r"apache\s+(?:software\s+)?licen[cs]e", "apache", ("1.0", "1.1", "2.0")),
    ("mpl", r"mozilla\s+public\s+licen[cs]e", "mozilla public", ("1.0", "1.1", "2.0")),
    ("epl", r"eclipse\s+public\s+licen[cs]e", "eclipse public", ("1.0", "2.0")),
    ("cddl", r"common\s+development\s+and\s+distribution\s+licen[cs]e", "development and distribution", ("1.0", "1.1")),
    ("cpl", r"common\s+public\s+licen[cs]e", "common public licen", ("1.0",)),
    ("eupl", r"european\s+union\s+public\s+licen[cs]e", "european union public", ("1.0", "1.1", "1.2")),
    ("osl", r"open\s+software\s+licen[cs]e", "open software licen", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", r"academic\s+free\s+licen[cs]e", "academic free", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", r"artistic\s+licen[cs]e", "artistic licen", ("1.0", "2.0")),
    ("bsl", r"boost\s+software\s+licen[cs]e", "boost software", ("1.0",)),
    ("busl", r"business\s+source\s+licen[cs]e", "business source", ("1.0", "1.1")),
    ("mit", r"(?:mit|expat|x11)\s+licen[cs]e", "licen", ()),
    ("isc", r"isc\s+licen[cs]e", "isc licen", ()),
    ("bsd", r"(?:(?:two|three|four|[0234])[- ]clause\s+|new\s+|simplified\s+|modified\s+)?bsd\s+licen[cs]e", "bsd", ()),
    ("zlib", r"zlib(?:/libpng)?\s+licen[cs]e", "zlib", ()),
    ("psf", r"python\s+software\s+foundation\s+licen[cs]e", "python software foundation", ("2",)),
    ("php", r"php\s+licen[cs]e", "php licen", ("2.02", "3.0", "3.01")),
    ("zope", r"zope\s+public\s+licen[cs]e", "zope public", ("1.1", "2.0", "2.1")),
    ("w3c", r"w3c\s+(?:software\s+)?(?:notice\s+and\s+)?licen[cs]e", "w3c", ()),
    ("unicode", r"unicode\s+(?:terms\s+of\s+use|licen[cs]e)", "unicode", ()),
    ("ofl", r"(?:sil\s+)?open\s+font\s+licen[cs]e", "open font", ("1.0", "1.1")),
    ("odbl", r"open\s+(?:data\s+commons\s+open\s+)?database\s+licen[cs]e", "database licen", ("1.0",)),
    ("odc-by", r"open\s+data\s+commons\s+attribution\s+licen[cs]e", "open data commons", ("1.0",)),
    ("pddl", r"public\s+domain\s+dedication\s+and\s+licen[cs]e", "public domain dedication", ("1.0",)),
    ("cecill", r"cecill(?:-[bc])?\s+(?:free\s+software\s+)?licen[cs]e", "cecill", ("1.0", "2.0", "2.1")),
    ("wtfpl", r"do\s+what\s+the\s+f\w+\s+you\s+want\s+to\s+public\s+licen[cs]e", "you want to public", ("1", "2")),
    ("unlicense", r"the\s+unlicense", "unlicense", ()),
    ("ecl", r"educational\s+community\s+licen[cs]e", "educational community", ("1.0", "2.0")),
    ("rpl", r"reciprocal\s+public\s+licen[cs]e", "reciprocal public", ("1.1", "1.5")),
    ("ms-pl", r"microsoft\s+(?:public|reciprocal)\s+licen[cs]e", "microsoft", ()),
    ("openssl", r"openssl\s+licen[cs]e", "openssl", ()),
    ("postgresql", r"postgresql\s+licen[cs]e", "postgresql", ()),
    ("ogl", r"open\s+government\s+licen[cs]e", "open government", ("1.0", "2.0", "3.0")),
    ("ncsa", r"university\s+of\s+illinois(?:/ncsa)?\s+open\s+source\s+licen[cs]e", "university of illinois", ()),
    ("upl", r"universal\s+permissive\s+licen[cs]e", "universal permissive", ("1.0",)),
    ("mulan", r"mulan\s+permissive\s+software\s+licen[cs]e", "mulan", ("1", "2")),
]
CC_PARTS = {"by": "attribution", "sa": "share[- ]?alike", "nc": "non[- ]?commercial", "nd": "no[- ]?deriv(?:ative)?s?(?:\\s+works)?"}
CC_KINDS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# Sentences that name no licence: label, keyword, pattern.
SENTENCES = [
    ("mit", "permission is hereby granted", r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge"),
    ("bsd", "redistribution and use", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms"),
    ("isc", "permission to use, copy", r"permission\s+to\s+use,\s+copy,\s+modify,?\s+and(?:/or)?\s+distribute"),
    ("zlib", "as-is", r"provided\s+['\"]?as-is['\"]?,\s+without\s+any\s+express\s+or\s+implied\s+warranty"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated)\s+(?:in)?to\s+the\s+public\s+domain"),
    ("public-domain", "public domain", r"public\s+domain"),
    ("copyright", "copyright", r"copyright\s+(?:\(c\)\s*|\xc2\xa9\s*)?(?:19|20)\d\d(?:\s*[-,]\s*(?:19|20)\d\d)*"),
    ("reserved", "rights reserved", r"(?:all|some|no)\s+rights\s+reserved"),
    ("proprietary", "proprietary", r"proprietary\s+(?:and|&)\s+confidential"),
    # up to the end of the sentence; from the last "may not be" before the permission, so that a long sentence is read once
    ("proprietary", "may not be", r"may\s+not\s+be\s+(?:reproduced|copied|distributed)(?:(?!may\s+not\s+be\s+(?:reproduced|copied|distributed))[^.])*?"
                                  r"without\s+(?:prior\s+)?(?:written\s+)?permission"),
    ("non-commercial", "commercial", r"(?:for\s+)?non[- ]?commercial\s+(?:use|purposes)\s+only"),
    ("cc0", "cc0", r"\bcc0(?:[- ]1\.0)?\b"),
    ("unlicense", "unencumbered", r"free\s+and\s+unencumbered\s+software"),
]


def _family_rules(label, name, keyword, versions):
    under = r"(?:licen[cs]ed|released|distributed|published|available|provided)\s+under\s+(?:the\s+terms\s+of\s+)?(?:the\s+)?"
    yield Rule(label, 30, keyword, _pattern(under + name), 0.9)
    yield Rule(label, 10, keyword, _pattern(r"\b" + name), 0.6)
    yield Rule(label, 50, "spdx", _pattern(r"spdx-license-identifier:\s*" + re.escape(label) + r"\b[-\w.+]*"), 1.0)
    for v in versions:
        num = re.escape(v.removesuffix(".0")) + r"(?:\.0)?(?![.\d]*\d)"
        ver = r",?\s+(?:version|v\.?)?\s*" + num
        later = r"(?:\s+or\s+(?:\(at\s+your\s+option\)\s+)?(?:any\s+)?later(?:\s+version)?)?"
        yield Rule(f"{label}-{v}", 40, keyword, _pattern(under + name + ver + later), 1.0)
        yield Rule(f"{label}-{v}", 20, keyword, _pattern(r"\b" + name + ver + later), 0.8)
        short = r"\b" + re.escape(label) + r"[- ]?v?" + num
        yield Rule(f"{label}-{v}", 15, label, _pattern(short), 0.7)


def _cc_rules():
    for kind in CC_KINDS:
        parts = kind.split("-")
        short = r"\bcc[- ]" + r"[- ]".join(parts) + r"(?![- ](?:sa|nc|nd)\b)"
        long = r"creative\s+commons\s+" + r"[- ,]+".join(CC_PARTS[p] for p in parts) + r"(?![- ]+(?:share|non|no[- ]?deriv))"
        yield Rule(f"cc-{kind}", 12, "cc", _pattern(short + r"\b"), 0.7)
        yield Rule(f"cc-{kind}", 12, "creative commons", _pattern(long), 0.8)
        for v in CC_VERSIONS:
            num = re.escape(v)
            yield Rule(f"cc-{kind}-{v}", 22, "cc", _pattern(short + r"[- ]" + num), 0.9)
            yield Rule(f"cc-{kind}-{v}", 32, "creative commons",
                       _pattern(long + r"(?:\s+(?:international|unported|generic))?\s+" + num), 1.0)
            yield Rule(f"cc-{kind}-{v}", 42, "creativecommons.org",
                       _pattern(r"creativecommons\.org/licenses/" + re.escape(kind) + "/" + num), 1.0)


def rules() -> list[Rule]:
    """All rules in order: priority first, then as listed."""
    out = [r for f in FAMILIES for r in _family_rules(*f)] + list(_cc_rules())
    out += [Rule(label, 35, keyword, _pattern(p.replace(" ", r"\s+")), 0.95) for label, keyword, p in NOTICES]
    out += [Rule(label, 14, keyword, _pattern(p), 0.7) for label, keyword, p in SENTENCES]
    return sorted(out, key=lambda r: -r.priority)


def contained(spans: list[tuple[int, int]]) -> list[bool]:
    """For spans in order of preference: does an earlier span hold this one?

    Containment passes on, so asking all earlier spans is the same as asking
    the kept ones. Sweep by start; a Fenwick tree over the ends holds the
    best rank among spans that end at or after a point.
    """
    ends = sorted({e for _, e in spans}, reverse=True)
    place = {e: i + 1 for i, e in enumerate(ends)}
    best = [len(spans)] * (len(ends) + 1)
    out = [False] * len(spans)
    order = sorted(range(len(spans)), key=lambda r: spans[r][0])
    at = 0
    while at < len(order):
        stop = at
        while stop < len(order) and spans[order[stop]][0] == spans[order[at]][0]:
            i = place[spans[order[stop]][1]]
            while i <= len(ends):
                best[i] = min(best[i], order[stop])
                i += i & -i
            stop += 1
        for rank in order[at:stop]:
            i, found = place[spans[rank][1]], len(spans)
            while i:
                found = min(found, best[i])
                i -= i & -i
            out[rank] = found < rank
        at = stop
    return out


class Scanner:
    """Rules and their keyword automaton; built once in each Python worker."""

    def __init__(self, ruleset: list[Rule]):
        import ahocorasick
        self.rules = ruleset
        gates: dict[str, list[int]] = {}
        for n, r in enumerate(ruleset):
            gates.setdefault(r.keyword, []).append(n)
        self.gate = ahocorasick.Automaton()
        for keyword, ns in gates.items():
            self.gate.add_word(keyword, ns)
        self.gate.make_automaton()

    def scan(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) kept after suppression; ``raw`` is the lower-cased text."""
        low = raw.decode("latin-1")
        due: set[int] = set()
        # patterns take any run of spaces for one, so the keywords are looked for with single spaces
        for _, ns in self.gate.iter(b" ".join(raw.split()).decode("latin-1")):
            if ns[0] not in due:
                due.update(ns)
        found = [(n, m.start(), m.end()) for n in due for m in self.rules[n].pattern.finditer(low) if m.end() > m.start()]
        found.sort(key=lambda f: (-self.rules[f[0]].priority, f[1] - f[2], f[1], f[0]))
        kept = [(lo, hi, n) for (n, lo, hi), inside in zip(found, contained([f[1:] for f in found])) if not inside]
        return sorted(kept)


_SCANNERS: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNERS:
        _SCANNERS.append(Scanner(rules()))
    return _SCANNERS[0]


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else (b if tb.ALNUM_WORD[b] else 32) for b in range(256))
_PHRASES = [(f" {p} ".encode(), label) for p, label in BASE.items()]

_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType())])
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("base_at", T.ArrayType(T.LongType())),
    T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(_SPAN)),
    T.StructField("score", T.DoubleType())])
_ARROW = pa.struct([("n_words", pa.int64()), ("base_at", pa.list_(pa.int64())), ("base_labels", pa.list_(pa.string())),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))),
                    ("score", pa.float64())])


def scan_text(text: str | None) -> dict:
    """Base places (word numbers, one for each phrase found), and kept detections as character spans."""
    raw = (text or "").encode()
    words = raw.translate(_TO_WORDS).split()
    norm = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in _PHRASES:
        at = norm.find(phrase)
        while at >= 0:
            places.append(norm.count(b" ", 0, at))
            base.add(label)
            at = norm.find(phrase, at + 1)
    s = scanner()
    kept = s.scan(raw.translate(_LOWER))
    spans = []
    if kept:
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        spans = [{"start": int(chars[lo]), "end": int(chars[hi]), "label": s.rules[n].label} for lo, hi, n in kept]
    sure = [s.rules[n].confidence for _, _, n in kept] + [0.6] * bool(base)
    return {"n_words": len(words), "base_at": sorted(places), "base_labels": sorted(base), "spans": spans,
            "score": max(sure, default=0.0)}


def scan_licenses(docs: DataFrame, text_col: str = "text", out: str = "found") -> DataFrame:
    """``docs`` plus a struct ``out`` (see FOUND; replaced if there)."""
    docs = docs.drop(out)
    def run(batches):
        for b in batches:
            got = pa.array([scan_text(t.as_py()) for t in b.column(text_col)], _ARROW)
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, FOUND)]))


def op9(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = F.array_sort(F.array_union("found.base_labels", F.transform("found.spans", lambda s: s["label"])))
    return out.select("doc_id", F.col("found.n_words").alias("n_words"), F.size("found.base_at").cast("long").alias("n_base"),
                      F.array_min("found.base_at").alias("first_word"), F.array_max("found.base_at").alias("last_word"),
                      F.array_join("found.base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
                      F.col("found.score").alias("score"))
