"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

A candidate is a maximal run of 12 or more of ``[A-Za-z0-9+/_=-]``. The network
reads its characters with 24 bytes before and 16 after; a candidate longer than
one view is read in several, and the best score counts. It is trained in numpy
on labelled findings: secrets and look-alikes drawn by rule, half of them put
into contexts cut from a bounded sample of the corpus, together with that
sample's own candidates, labelled by the fixed patterns. What is held out, by
document and by line, calibrates the scores (Platt) and sets the threshold: the
highest one that still finds ``RECALL`` of the held-out secrets.

Scanning is one pass over whole texts without a shuffle; the network (some
thousand weights) travels with the tasks.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.llm.textkit import one_row_each, parts, runs, slices, smallest_hashed, texts_of
from massloom.plans.shipping import ship
from massloom.plans.store import materialize

ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ["assign", "access", "hex", "model"]
SHORTEST = 12
BEFORE, VIEW, AFTER = 24, 56, 16
WIDTH, DIMS, FILTERS = 5, 8, 24
RECALL = 0.95
#: Documents whose candidates and contexts join the training set, and views of each label taken from them, at most.
SAMPLE_DOCS, SAMPLE_VIEWS = 400, 3_000
GENERATED, EPOCHS, SEED = 6_000, 12, 17


def in_set(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in chars]] = True
    return table


HEX = in_set("0123456789abcdef")
TOKEN = in_set(string.ascii_letters + string.digits + "+/_=-")


def char_codes() -> np.ndarray:
    """Byte -> code: 0 is padding, printable ASCII has a code each, line ends one, all other bytes one."""
    table = np.full(256, 97, dtype=np.int64)
    table[32:127] = np.arange(1, 96)
    table[[9, 10, 13]] = 96
    return table


CODES = 98


def views(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, owner): the views of candidates [start, end) in documents [lo, hi)."""
    parts = -(-(end - start) // VIEW)
    owner = np.repeat(np.arange(len(start)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    s, e, a, b = start[owner] + nth * VIEW, end[owner], lo[owner], hi[owner]
    table = char_codes()

    def at(index: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(good, table[data[np.clip(index, 0, len(data) - 1)]], 0)

    left = start[owner][:, None] - BEFORE + np.arange(BEFORE)
    mid = s[:, None] + np.arange(VIEW)
    right = e[:, None] + np.arange(AFTER)
    return np.hstack([at(left, left >= a[:, None]), at(mid, mid < e[:, None]), at(right, right < b[:, None])]), owner


@dataclass
class CharNet:
    """Embedding, one convolution, maxima over the three parts of a view, one logistic unit."""

    emb: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> CharNet:
        f = np.float32
        return cls(rng.normal(0, 0.3, (CODES, DIMS)).astype(f), rng.normal(0, 0.25, (WIDTH * DIMS, FILTERS)).astype(f), np.zeros(FILTERS, f), rng.normal(0, 0.1, 3 * FILTERS + 1).astype(f))

    @staticmethod
    def parts() -> list[tuple[int, int]]:
        last = BEFORE + VIEW + AFTER - WIDTH + 1
        return [(0, BEFORE - WIDTH + 1), (BEFORE - WIDTH + 1, BEFORE + VIEW), (BEFORE + VIEW, last)]

    def forward(self, codes: np.ndarray) -> tuple:
        x = self.emb[codes]
        n, length = codes.shape
        cols = np.concatenate([x[:, j : length - WIDTH + 1 + j] for j in range(WIDTH)], axis=2)
        h = np.maximum(cols.reshape(-1, WIDTH * DIMS) @ self.conv + self.bias, 0).reshape(n, -1, FILTERS)
        top = [h[:, a:b].argmax(axis=1) + a for a, b in self.parts()]
        pooled = np.concatenate([np.take_along_axis(h, t[:, None], axis=1)[:, 0] for t in top], axis=1)
        return cols, top, pooled, pooled @ self.out[:-1] + self.out[-1]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(codes[i : i + 1024])[3] for i in range(0, len(codes), 1024)]) if len(codes) else np.zeros(0, np.float32)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.logits(codes).astype(np.float64) + self.offset)))

    def fit(self, codes: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """Adam on the logistic loss, classes weighted alike."""
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        names = ["emb", "conv", "bias", "out"]
        m, v, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(y))
            for i in range(0, len(y), 128):
                pick = order[i : i + 128]
                c = codes[pick]
                cols, top, pooled, z = self.forward(c)
                d = ((1 / (1 + np.exp(-z)) - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                grads = {"out": np.r_[pooled.T @ d, d.sum()] + 1e-4 * self.out}
                dp = d[:, None] * self.out[:-1] * (pooled > 0)
                dconv, dbias, demb = np.zeros_like(self.conv), np.zeros_like(self.bias), np.zeros_like(self.emb)
                rows = np.arange(len(pick))
                for p, t in enumerate(top):
                    g = dp[:, p * FILTERS : (p + 1) * FILTERS]
                    seen = cols[rows[:, None], t]
                    dconv += np.einsum("nfk,nf->kf", seen, g)
                    dbias += g.sum(axis=0)
                    back = np.einsum("nf,kf->nfk", g, self.conv).reshape(len(pick), FILTERS, WIDTH, DIMS)
                    for j in range(WIDTH):
                        np.add.at(demb, c[rows[:, None], t + j], back[:, :, j])
                grads |= {"conv": dconv, "bias": dbias, "emb": demb}
                step += 1
                rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
                for k in names:
                    m[k], v[k] = 0.9 * m[k] + 0.1 * grads[k], 0.999 * v[k] + 0.001 * grads[k] ** 2
                    setattr(self, k, (getattr(self, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))

    def calibrate(self, codes: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling, then the highest threshold that keeps RECALL of the positives given."""
        z = self.logits(codes).astype(np.float64)
        goal = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-(a * z + b)))
            g, w = p - goal, np.maximum(p * (1 - p), 1e-6)
            ga, gb = (g * z).mean() + 1e-3 * (a - 1), g.mean()
            haa, hab, hbb = (w * z * z).mean() + 1e-3, (w * z).mean(), w.mean() + 1e-6
            det = haa * hbb - hab * hab
            a, b = a - 0.5 * (hbb * ga - hab * gb) / det, b - 0.5 * (haa * gb - hab * ga) / det
        self.slope, self.offset = float(a), float(b)
        found = np.sort(1 / (1 + np.exp(-(a * z[y == 1] + b))))
        self.threshold = float(found[int((1 - RECALL) * len(found))]) if len(found) else 0.5


def generated_findings(n: int, rng: np.random.Generator) -> list[tuple[bytes, int, int, int]]:
    """(line, start, end, label) drawn by rule: secrets and look-alikes in contexts of either kind."""

    def draw(chars: str, lo: int, hi: int) -> str:
        return "".join(rng.choice(list(chars), rng.integers(lo, hi + 1)))

    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ou", "ver", "ten", "ción", "eau", "sch", "lich", "ment", "qu", "io"], rng.integers(1, 5)))
    prose = lambda k: " ".join(word() for _ in range(k))
    cap = lambda: word().capitalize()
    leet = str.maketrans("aeiost", "431057")

    def password() -> str:
        """A word or two with digits in place of letters, capitals and a number."""
        own = (word() + word() + word())[:12]
        return "".join(c.upper() if rng.random() < 0.3 else c.translate(leet) if rng.random() < 0.6 else c for c in own) + draw(dig, 2, 5)

    secret = [
        lambda: draw(dig + "abcdef", 32, 64), lambda: draw(dig + "ABCDEF", 24, 64), lambda: draw(low + up + dig, 20, 48), lambda: draw(low + up + dig + "+/", 28, 64) + "=" * int(rng.integers(0, 3)),
        lambda: "AKIA" + draw(up + dig, 16, 16), lambda: "ghp_" + draw(low + up + dig, 36, 36), lambda: "sk-" + draw(low + up + dig, 32, 48), lambda: "xoxb-" + draw(dig, 11, 12) + "-" + draw(low + up + dig, 24, 24),
        lambda: "eyJ" + draw(low + up + dig + "_-", 40, 90), lambda: draw(low + up + dig + "_-", 24, 44), password, lambda: draw(low, 2, 4) + rng.choice(["_", "-"]) + draw(low + up + dig, 18, 30),
    ]
    decoy = [
        lambda: (word() + word() + word() + word() + word())[:40], lambda: "_".join(word() for _ in range(4)), lambda: "-".join(word() for _ in range(4)), lambda: (word() + word() + word() + word()).upper() + "TIONER", lambda: draw(dig, 12, 19), lambda: "/" + "/".join(word() for _ in range(4)) + "/" + draw(dig, 1, 4),
        lambda: f"20{draw(dig, 2, 2)}-{draw(dig, 2, 2)}-{draw(dig, 2, 2)}-{word()}{word()}", lambda: "=" * int(rng.integers(12, 50)), lambda: "-" * int(rng.integers(12, 50)), lambda: "".join(cap() for _ in range(5)), lambda: (word() + word())[:10].capitalize() + draw(dig, 1, 2) + "-" + word() + word(),
        lambda: (word() + word() + word() + word() + word()).upper()[:40], lambda: (word() + word() + word() + word()).capitalize(), lambda: cap() + "-" + (word() + word() + word()).upper(),
        # look-alikes: identifiers, numbers with separators, names with versions, dates with times
        lambda: "-".join(draw(dig + "abcdef", k, k) for k in (8, 4, 4, 4, 12)), lambda: "-".join(draw(dig, 4, 4) for _ in range(4)), lambda: f"{word()[:3].upper()}-20{draw(dig, 2, 2)}-{draw(dig, 5, 8)}", lambda: word() + cap() + draw(dig, 1, 1) + cap() + cap(), lambda: f"{word()}_{word()}_{draw(dig, 3, 8)}",
        lambda: f"/{word()}/{word()}{draw(dig, 1, 2)}/{word()}-{word()}/{word()}", lambda: f"20{draw(dig, 2, 2)}{draw(dig, 4, 4)}T{draw(dig, 6, 6)}Z", lambda: f"{word()}{word()}{draw(dig, 1, 4)}x{draw(dig, 1, 4)}", lambda: f"+{draw(dig, 2, 2)}-{draw(dig, 3, 3)}-{draw(dig, 6, 8)}", lambda: f"{cap()}{cap()}-{draw(dig, 1, 3)}-{word()}-{draw(dig, 2, 4)}",
    ]
    names = ["token", "secret", "password", "api_key", "apikey", "key", "auth", "credential", "client_secret", "access", "bearer", "private", "TOKEN", "SECRET"]
    marks = [' = "', ": ", "=", " = ", '": "', "='", " "]
    out = []
    for k in range(n):
        label = k % 2
        value = (secret if label else decoy)[rng.integers(len(secret if label else decoy))]()
        value = re.sub(r"[^A-Za-z0-9+/_=-]", "", value)
        value += draw(low, SHORTEST, SHORTEST)[: max(0, SHORTEST - len(value))] if len(value) < SHORTEST else ""
        how, mark = rng.random(), str(rng.choice(marks))
        before, after = prose(int(rng.integers(0, 6))) + " ", str(rng.choice([" ", ".", "\n", "!! ", ", "])) + prose(int(rng.integers(0, 3)))
        if how < (0.5 if label else 0.1):
            before, after = before + str(rng.choice(names)) + mark, ('"' if mark.endswith('"') else "") + after
        elif how < (0.65 if label else 0.13):
            before, after = before + f"{word()}://{word()}:", "@" + word() + after
        line = before.encode()
        out.append((line + value.encode() + after.encode(), len(line), len(line) + len(value), label))
    return out


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of every candidate of a slice, in byte positions of the slice."""
    start, end, _ = runs(TOKEN[data], offsets)
    long = end - start >= SHORTEST
    start, end = start[long], end[long]
    return np.searchsorted(offsets, start, side="right") - 1, start, end


def base_findings(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns in byte positions, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12] if b":" in text or b"=" in text else []
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    data = np.frombuffer(text, dtype=np.uint8)
    start, end, _ = runs(HEX[data], np.array([0, len(data)]))
    long = end - start >= 16
    return sorted(found + [(int(a), 2, int(b)) for a, b in zip(start[long], end[long], strict=True)])


#: Candidates that no pattern fits and that are plainly no secrets: words with a short number, or digits with separators.
PLAIN = re.compile(rb"(?=.*[^0-9])[A-Za-z]*(?:[-_/][A-Za-z]*)*[-_/=]?[0-9]{0,4}|(?=.*[^0-9])[0-9+/_=-]+")


def corpus_views(docs: DataFrame, most_docs: int = SAMPLE_DOCS, most: int = SAMPLE_VIEWS) -> list:
    """(label, part, before, middle, after) from at most ``most_docs`` documents, ``most`` of each label.

    Label 1 is a view of a candidate inside a fixed-pattern finding, 0 a view of
    one that is plainly none, 2 a context: what stands around a gap between
    words. Other candidates are not known to be either and are left out. An id
    of several rows gives one text. Only these short cuts leave the executors.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 16):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, part = text.encode(), doc_id % 4
                data = np.frombuffer(text, dtype=np.uint8)
                spans = base_findings(text)
                for _, a, b in zip(*candidates(data, np.array([0, len(data)])), strict=True):
                    found = any(s < b and a < e for s, _, e in spans)
                    if found and not text[a:b].isdigit() or not found and PLAIN.fullmatch(text[a:b]):
                        rows += [(int(found), part, text[max(0, a - BEFORE) : a], text[i : min(b, i + VIEW)], text[b : b + AFTER]) for i in range(a, b, VIEW)]
                rng = np.random.default_rng(abs(doc_id))
                gaps = np.flatnonzero(data == 32)
                for g in rng.choice(gaps, min(8, len(gaps)), replace=False) if len(gaps) else []:
                    rows.append((2, part, text[max(0, g + 1 - BEFORE) : g + 1], b"", text[g : g + AFTER]))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], ["label", "part", "before", "middle", "after"])

    ids = smallest_hashed(docs.select("doc_id").dropna(), most_docs, "doc_id").distinct()
    sample = one_row_each(docs.dropna().join(F.broadcast(ids), "doc_id"), "doc_id", "text")
    cut = materialize(sample.mapInArrow(kernel, "label int, part int, before binary, middle binary, after binary"), "secrets-views")
    key = [F.xxhash64("part", "before", "middle", "after"), "before", "middle", "after", "part"]
    return [r for label in (0, 1, 2) for r in cut.filter(F.col("label") == label).orderBy(*key).limit(most).collect()]


def train(docs: DataFrame, seed: int = SEED) -> CharNet:
    """A calibrated network from generated findings and a bounded sample of the corpus.

    A quarter of the generated lines and of the sampled documents is held out
    of the fit, for calibration and threshold. Nulls give nothing; an empty
    table leaves the generated lines alone.
    """
    rng = np.random.default_rng(seed)
    lines = generated_findings(GENERATED, rng)
    held = list(rng.random(len(lines)) < 0.25)
    cut = corpus_views(docs)
    around = [(r.before, r.after, r.part == 0) for r in cut if r.label == 2]
    for i in range(0, len(lines), 2) if around else ():
        k = i + i % 4 // 2  # one of each pair, of either label in turn
        before, after, out = around[int(rng.integers(len(around)))]
        text, a, b, label = lines[k]
        lines[k], held[k] = (bytes(before) + text[a:b] + bytes(after), len(before), len(before) + b - a, label), out
    for r in cut:
        forms = [bytes] if r.label == 1 else [bytes, lambda x: bytes(x).upper()] if r.label == 0 else []  # words in capitals are words
        for form in forms:
            before, middle, after = form(r.before), form(r.middle), form(r.after)
            lines.append((before + middle + after, len(before), len(before) + len(middle), r.label))
            held.append(r.part == 0)
    codes, y, apart = [], [], []
    one = lambda v: np.array([v])
    for (text, a, b, label), out in zip(lines, held, strict=True):
        own = views(np.frombuffer(text, dtype=np.uint8), one(0), one(len(text)), one(a), one(b))[0]
        codes.append(own)
        y += [label] * len(own)
        apart += [out] * len(own)
    codes, y, apart = np.concatenate(codes), np.array(y), np.array(apart)
    net = CharNet.fresh(rng)
    net.fit(codes[~apart], y[~apart], rng)
    net.calibrate(codes[apart], y[apart])
    return net


FOUND = "doc_id long, starts array<int>, kinds array<int>, ends array<int>, scores array<double>"


def scan_batch(texts: pa.Array, model: CharNet) -> Iterator[tuple[int, list[tuple[int, int, int, float]]]]:
    """(row, [(start, kind, end, score)]) for the rows with findings, in code points."""
    for first, last, data, offsets in slices(texts):
        row, start, end = candidates(data, offsets)
        score = np.zeros(len(start))
        for i in range(0, len(start), 4096):
            k = slice(i, i + 4096)
            codes, owner = views(data, offsets[row[k]], offsets[row[k] + 1], start[k], end[k])
            np.maximum.at(score[k], owner, model.probability(codes))
        # rows that a fixed pattern can match: an assignment needs a mark, the others a long run
        hs, he, _ = runs(HEX[data], offsets)
        asks = np.zeros(last - first, dtype=bool)
        for at in (np.flatnonzero((data == 58) | (data == 61)), hs[he - hs >= 16], start[score >= model.threshold], start[end - start >= 18]):
            asks[np.searchsorted(offsets, at, side="right") - 1] = True
        for r in np.flatnonzero(asks):
            a, b = int(offsets[r]), int(offsets[r + 1])
            base = base_findings(data[a:b].tobytes())
            found = [(s, k, e, 1.0) for s, k, e in base]
            for c in range(int(np.searchsorted(row, r, side="left")), int(np.searchsorted(row, r, side="right"))):
                s, e = int(start[c]) - a, int(end[c]) - a
                if score[c] >= model.threshold and not any(x < e and s < y for x, _, y in base):
                    found.append((s, 3, e, float(score[c])))
            if found:
                points = np.zeros(b - a + 1, dtype=np.int64)
                np.cumsum((data[a:b] & 0xC0) != 0x80, out=points[1:])
                yield first + int(r), [(int(points[s]), k, int(points[e]), p) for s, k, e, p in sorted(found)]


def find_secrets(docs: DataFrame, net: CharNet | None = None) -> DataFrame:
    """(doc_id, starts, kinds, ends, scores) for each row: spans in code points, by start and kind.

    Kinds count from 0 as in KINDS; the score is 1 for the fixed patterns and
    the calibrated probability for candidates that the network adds. A
    candidate that overlaps a fixed finding adds nothing. Null texts count as
    empty and have no findings; rows of any id, repeated or null, are scanned
    each for itself; a score equal to the threshold counts; findings of one
    start come in the order of KINDS; extra columns are not read. A text is
    scanned whole: one longer than a slice is a slice of its own. An empty
    table gives no rows.
    """
    docs = texts_of(docs)
    net = ship(docs.sparkSession, net or train(docs))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            for row, found in scan_batch(batch.column(1), net.value):
                spans[row] = found
            cols = [pa.array([[x[j] for x in s] for s in spans], pa.list_(t)) for j, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))]
            yield pa.record_batch([batch.column(0), *cols], ["doc_id", "starts", "kinds", "ends", "scores"])

    return docs.mapInArrow(kernel, FOUND)


def span_digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the fixed findings and all spans as one string."""
    names = F.array(*[F.lit(k) for k in KINDS])
    told = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda x: F.concat_ws(":", F.get(names, x["kinds"]), x["starts"], x["ends"]))
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long")
    base = F.filter(told, lambda x: ~x.startswith("model:"))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(told, ",").alias("spans"))


def redact(docs: DataFrame, net: CharNet | None = None, mark: str = "<SECRET>") -> DataFrame:
    """The rows of ``docs`` with each secret in ``text`` replaced by ``mark``; n_chars follows where it exists.

    Overlapping spans become one mark. Rows without findings, and null texts,
    stay as they are; repeated rows and null ids are cleaned each for itself;
    all other columns are kept, whatever their names. Very long texts are
    cleaned whole; an empty table gives no rows.
    """
    net = ship(docs.sparkSession, net or train(texts_of(docs)))
    where, schema = docs.columns.index("text"), docs.schema
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text: str | None, starts: list[int], ends: list[int]) -> str | None:
        out, at = [], 0
        for a, b in zip(starts, ends, strict=True):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join(out) + text[at:] if starts else text

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(where).to_pylist()
            for k, found in scan_batch(batch.column(where), net.value):
                texts[k] = clean(texts[k], [s for s, *_ in found], [e for _, _, e, _ in found])
            cols = list(batch.columns)
            cols[where] = pa.array(texts, batch.schema.field(where).type)
            if size is not None:
                cols[size] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(kernel, schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts, digest and spans; odd rows as in :func:`find_secrets`."""
    return span_digest(find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")))
