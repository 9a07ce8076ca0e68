"""License scan with a positional index of rare licence words.

Base phrases count wherever their words stand consecutively. The method's own
labels come from templates: every template is indexed by its RARE words of
highest IDF, where document frequencies are counted over the whole corpus. A
file looks up those of its words that are in the index; each hit votes for
(template, place in the file minus place in the template), and votes of
different words that agree intersect the postings at one relative position. A
position with at least half of the template's rare words is compared with the
template word by word; the label holds if the mandatory key phrase stands there
and at least MIN_MATCH of the template's words agree. A key phrase does not
count where a longer one that begins with it stands ("cc by" in "cc by nc 4 0").

score: the best matching share of an accepted template, else BASE_SCORE if a
base phrase occurs, else 0.

Cases: null text is empty (no words, no labels, score 0); repeated rows are
scanned alike; an empty table gives no rows; other columns are ignored. Places
in a file are looked up in the order of its words, so ties between templates
don't matter: all accepted labels are kept.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import table

#: fixed values: base phrases and their labels
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: label -> (mandatory key phrase, template)
TEMPLATES = {
    "mit-notice": ("under the mit license", "released under the mit license"),
    "mit-text": (
        "permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
    ),
    "apache-2.0": ("apache license version 2 0", "licensed under the apache license version 2 0"),
    "gpl-3.0": ("gnu general public license version 3", "licensed under the gnu general public license version 3"),
    "gpl-2.0": ("gnu general public license version 2", "licensed under the gnu general public license version 2"),
    "lgpl": ("gnu lesser general public license", "licensed under the gnu lesser general public license"),
    "bsd-text": (
        "redistribution and use in source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    ),
    "mpl-2.0": ("mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    "isc-text": (
        "permission to use copy modify and or distribute",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "cc-by": ("creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    # "cc by" alone is also a phrase of letters, so without a version it needs the words before it
    "cc-by-notice": ("cc by", "licensed under cc by"),
}
#: the short Creative Commons forms, which are their own key phrases
CC_FORMS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
TEMPLATES |= {
    label: (phrase, phrase)
    for label in [f"cc-{x}-{v}" for x in CC_FORMS for v in CC_VERSIONS] + [f"cc-{x}" for x in CC_FORMS if x != "by"]
    for phrase in [label.replace("-", " ").replace(".", " ")]
}
RARE = 4
MIN_MATCH = 0.75
BASE_SCORE = 0.5

#: A-Z to a-z; digits, a-z and all bytes from 0x80 are word characters, the rest separates
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_WORDS).split()


def vocabulary(templates: dict) -> list[bytes]:
    return sorted({w.encode() for _, text in templates.values() for w in text.split()})


def document_frequencies(docs: DataFrame, vocab: list[bytes]) -> tuple[int, dict[bytes, int]]:
    """Documents, and documents per licence word, over all rows; as many rows reach the driver as there are licence words."""
    wanted = frozenset(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = Counter(), 0
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                counts.update(wanted.intersection(words_of(text.as_py() or b"")))
                n += 1
        counts[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["word"]): r["n"] for r in rows}
    return found.pop(b"", 0), found


class Index:
    """Postings of each template's rarest words."""

    def __init__(self, templates: dict, frequency: dict[bytes, int], rare: int = RARE, min_match: float = MIN_MATCH):
        self.labels = list(templates)
        self.min_match = min_match
        self.keys = [k.encode().split() for k, _ in templates.values()]
        self.texts = [t.encode().split() for _, t in templates.values()]
        self.longer = [[k for k in self.keys if len(k) > len(key) and k[: len(key)] == key] for key in self.keys]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for number, text in enumerate(self.texts):
            # highest IDF is lowest document frequency
            best = sorted(set(text), key=lambda w: (frequency.get(w, 0), w))[:rare]
            self.needed.append((len(best) + 1) // 2)
            for place, word in enumerate(text):
                if word in best:
                    self.postings[word].append((number, place))

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """Accepted labels and their best matching share."""
        votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for place, word in enumerate(words):
            for number, at in self.postings.get(word, ()):
                votes[number, place - at].add(word)
        out: dict[str, float] = {}
        for (number, start), agreeing in votes.items():
            if len(agreeing) < self.needed[number]:
                continue
            text, key, longer = self.texts[number], self.keys[number], self.longer[number]
            places = range(max(0, start), min(len(words), start + len(text)) - len(key) + 1)
            if not any(words[i : i + len(key)] == key and not any(words[i : i + len(k)] == k for k in longer) for i in places):
                continue
            share = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(text)) / len(text)
            if share >= self.min_match:
                label = self.labels[number]
                out[label] = max(share, out.get(label, 0.0))
        return out


def base_places(words: list[bytes], phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """(first word, label) of each place of a base phrase."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases.items():
        at = joined.find(b" " + phrase + b" ")
        word, seen = 0, 0
        while at >= 0:
            word, seen = word + joined.count(b" ", seen, at), at
            out.append((word, label))
            at = joined.find(b" " + phrase + b" ", at + 1)
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: dict = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    _, frequency = document_frequencies(docs, vocabulary(templates))
    index = Index(templates, frequency)
    phrases = {p.encode(): label for p, label in base.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for text in batch.column("text").cast(pa.binary()):
                words = words_of(text.as_py() or b"")
                places = base_places(words, phrases)
                known = sorted({label for _, label in places})
                # a template needs several index words, so most files end here
                own = index.matches(words) if not index.postings.keys().isdisjoint(words) else {}
                starts = [p for p, _ in places]
                row = (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(known),
                       ",".join(sorted({*known, *own})), max(own.values(), default=BASE_SCORE if places else 0.0))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op8_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
