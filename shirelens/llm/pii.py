"""Personal data: rules for the plain forms, and boosted trees over candidates for the rest.

Base spans follow fixed patterns and checks and always stay.  Generators with high recall then propose overlapping spans of other
forms (numbers in groups without a plus, addresses with "at" and "dot", matches that failed a check), each with its kind.
Boosted trees score a candidate by its format (digits, groups, separators, checks) and its context (cue words, neighbours,
base spans near by).  Scores are calibrated on documents kept out of the fit, and each kind has the lowest threshold at which
its calibrated precision reaches PRECISION; of overlapping candidates above it the likeliest becomes a span.

Nobody has labelled these tables, so the trees learn from the rules: base spans rewritten in the other forms, in their own
context, are the positive examples; candidates that the generators find elsewhere, and base spans damaged in one place, the negative ones.
The sample is bounded: ``max_docs`` documents with the smallest hash of their text among those with a digit or an at sign.

Defined results: null and empty texts have no spans; repeated rows are searched each; a null id is kept; time is linear in the
length of a text, whatever its runs of digits or letters; without anything to learn from no span is added; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_DOCS = 4000
PRECISION = 0.95
TREES, DEPTH, RATE = 60, 3, 0.2
_BINS = 16
Span = tuple[int, int, int]  # start, end, kind

# --- base spans --------------------------------------------------------------------------------------------------------

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins: later starts in a run fail alike
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HAS = re.compile("[0-9@]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def small_part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) <= 3 and int(p or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, from each at sign outwards; no part of the text is looked at more than a few times."""
    out, done, at = [], 0, text.find("@")
    floor = 0
    while at >= 0:
        segment = text[max(done, floor):at]
        local = len(segment) - len(segment.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if local else None
        if m:
            out.append((at - local, m.end()))
            done = m.end()
        floor = at + 1
        at = text.find("@", max(at + 1, done))
    return out


def all_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind, whether the checks hold) of every match of the base patterns."""
    out = [(a, b, 0, True) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        out.append((m.start(), m.end(), 1, all(map(small_part, m.group().split(".")))))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 6:
            d = _digits(m.group())
            out.append((m.start(), m.end(), 2, 14 <= len(d) <= 19 and luhn(d)))
    if "+" in text:
        for m in _PHONE.finditer(text):
            out.append((m.start(), m.end(), 3, 10 <= len(_digits(m.group())) <= 15))
    return out


def base_spans(text: str) -> list[Span]:
    if not _HAS.search(text):
        return []
    return sorted((a, b, k) for a, b, k, good in all_matches(text) if good)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


# --- candidates --------------------------------------------------------------------------------------------------------

_NUMBER = re.compile(r"(?<![0-9])[(]?[0-9]+(?:[ ().\-/]{1,2}[0-9]+)+")
_AT = re.compile(r"@| at | ?[(\[]at[)\]] ?", re.I)
_TAIL = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| dot | ?[(\[]dot[)\]] ?)[A-Za-z0-9-]{1,63})+", re.I)
_WORD_BEFORE = re.compile(r"([^\W\d_]+)\W*\Z")
_CUES = (("mail", "contact", "write", "address"), ("ip", "host", "server", "addr"), ("card", "visa", "credit", "account", "iban"),
         ("tel", "phone", "call", "fax", "mobile", "whatsapp"))


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Overlapping proposals that touch no base span."""
    found: list[Span] = []
    for m in _NUMBER.finditer(text):
        n = len(_digits(m.group()))
        if n >= 7:
            found += [(m.start(), m.end(), k) for k, (lo, hi) in ((1, (4, 12)), (2, (13, 19)), (3, (7, 15))) if lo <= n <= hi
                      and (k != 1 or m.group().count(".") >= 3)]
    for m in _AT.finditer(text):
        left = text[max(0, m.start() - 64):m.start()]
        local = len(left) - len(left.rstrip(_LOCAL))
        tail = _TAIL.match(text, m.end()) if local else None
        if tail:
            found.append((m.start() - local, tail.end(), 0))
    found += [(a, b, k) for a, b, k, good in all_matches(text) if not good]
    starts = np.array([s[0] for s in base], np.int64)
    reach = np.maximum.accumulate(np.array([s[1] for s in base], np.int64)) if base else starts
    out = []
    for s in sorted(set(found)):
        k = int(np.searchsorted(starts, s[1])) - 1
        if k < 0 or reach[k] <= s[0]:
            out.append(s)
    return out


def describe(text: str, span: Span, near: np.ndarray) -> list[float]:
    """Format and context of a candidate; ``near`` holds the starts of the base spans."""
    a, b, kind = span
    s, before, after = text[a:b], text[max(0, a - 40):a], text[b:b + 40]
    groups = re.findall("[0-9]+", s)
    digits = "".join(groups)
    word = _WORD_BEFORE.search(before)
    word = word.group(1).lower() if word else ""
    k = int(np.searchsorted(near, a))
    gap = min([abs(int(near[i]) - a) for i in (k - 1, k) if 0 <= i < len(near)], default=9999)
    tail = re.split(r"\.| dot |[(\[]dot[)\]]", s)[-1]
    return [kind, len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
            len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, s.count("-"), s.count("."), s.count(" "), s.count("("),
            s.count("/"), "@" in s, " at " in s.lower(), " dot " in s.lower(), "[" in s or "(at" in s.lower(), len(tail),
            13 <= len(digits) <= 19 and luhn(digits), sum(map(small_part, groups)) if len(groups) < 9 else 0, s[:1] == "0", s[:1] == "+",
            before[-1:].isspace() or not before, before[-1:].isalnum(), before[-1:] in "\"'=:#$/", after[:1].isspace() or not after,
            after[:1].isalnum(), any(c in word for c in _CUES[kind]), any(c in before.lower() for c in _CUES[kind]),
            sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), min(gap, 2000)]


def _variants(text: str, span: Span) -> list[tuple[str, Span]]:
    """A base span in other forms, in its context."""
    a, b, kind = span
    s, left, right = text[a:b], text[max(0, a - 80):a], text[b:b + 80]
    if kind == 0:
        name, _, host = s.partition("@")
        forms = [f"{name} at {host}", f"{name} at {host.replace('.', ' dot ')}", f"{name}[at]{host.replace('.', '[dot]')}", f"{name} (at) {host}"]
    elif kind == 2:
        d = _digits(s)
        forms = [".".join(d[i:i + 4] for i in range(0, len(d), 4)), "/".join(d[i:i + 4] for i in range(0, len(d), 4))]
    elif kind == 3:
        d = _digits(s)
        local = s[1:].partition(" ")[2] or s[1:]
        forms = [s[1:], local, f"00{s[1:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}"]
    else:
        forms = []
    return [(left + f + right, (len(left), len(left) + len(f), kind)) for f in forms]


def _damaged(text: str, span: Span) -> list[tuple[str, Span]]:
    """A base span that a small change made into something else."""
    a, b, kind = span
    s, left, right = text[a:b], text[max(0, a - 80):a], text[b:b + 80]
    if kind == 1:
        forms = [re.sub("^[0-9]+", "999", s), re.sub("[0-9]+$", "4096", s), s + ".77"]
    elif kind == 2:
        forms = [s[:-1] + str((int(s[-1]) + 5) % 10), s[:-1].replace(" ", "-") + str((int(s[-1]) + 3) % 10)]
    elif kind == 3:
        d = _digits(s)
        forms = [f"{d[:4]}-{d[4:6]}-{d[6:8]}", f"{d[:4]}.{d[4:5]}.{d[5:8]}", f"{d[:8]} {d[8:]}", f"{d[:3]} {d[3:5]} {d[5:7]}"]
    else:
        forms = []
    return [(left + f + right, (len(left), len(left) + len(f), kind)) for f in forms]


def examples(text: str) -> tuple[list[list[float]], list[int]]:
    """Rows to learn from: features and labels."""
    base = base_spans(text)
    near = np.array([s[0] for s in base], np.int64)
    x, y = [], []
    for c in candidates(text, base):
        x.append(describe(text, c, near))
        y.append(0)
    for s in base:
        gap = [abs(int(v) - s[0]) for v in near if v != s[0]]
        for label, made in ((1, _variants(text, s)), (0, _damaged(text, s))):
            for piece, span in made:
                row = describe(piece, span, np.zeros(0, np.int64))
                row[-1] = min(gap, default=2000) if gap else 2000
                row[-1] = min(row[-1], 2000)
                x.append(row)
                y.append(label)
    return x, y


# --- boosted trees -----------------------------------------------------------------------------------------------------

@dataclass
class Trees:
    """Complete binary trees of DEPTH levels over feature values."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 2 ** DEPTH - 1), np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 2 ** DEPTH - 1)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 2 ** DEPTH)))
    start: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0), np.zeros(0)))  # calibration: scores, probabilities
    threshold: list[float] = field(default_factory=lambda: [2.0] * len(KINDS))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - (2 ** DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(self.steps[0]):
            return np.zeros(len(x))
        return self.steps[1][np.clip(np.searchsorted(self.steps[0], self.raw(x), "right") - 1, 0, None)]


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
    node = np.zeros(len(x), np.int64)
    for n in range(inner):
        rows = np.flatnonzero(node == n)
        best = 1e-6
        if len(rows) > 4:
            g, h = gradient[rows], hessian[rows]
            whole = g.sum() ** 2 / (h.sum() + 1)
            for f, values in enumerate(cuts):
                right = x[rows, f][:, None] > values[None]
                gr, hr = g @ right, h @ right
                gain = gr ** 2 / (hr + 1) + (g.sum() - gr) ** 2 / (h.sum() - hr + 1) - whole
                k = int(np.argmax(gain)) if len(values) else 0
                if len(values) and gain[k] > best:
                    best, feature[n], cut[n] = gain[k], f, values[k]
        node[rows] = 2 * n + 1 + (x[rows, feature[n]] > cut[n])
    for k in range(leaves):
        rows = node == inner + k
        leaf[k] = RATE * gradient[rows].sum() / (hessian[rows].sum() + 1)
    return feature, cut, leaf


def _calibrate(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: probabilities that never fall as scores rise."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # score, positives, rows
    for s, y in zip(score[order], label[order]):
        if blocks and blocks[-1][0] == s:
            blocks[-1][1] += y
            blocks[-1][2] += 1
        else:
            blocks.append([s, float(y), 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            s2, y2, n2 = blocks.pop()
            blocks[-1][1] += y2
            blocks[-1][2] += n2
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def train(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Trees:
    """Fit on the rows not held out, calibrate and set thresholds on the others."""
    fit = ~held
    if not (0 < y[fit].sum() < fit.sum()) or not held.any():
        return Trees()
    cuts = [np.unique(np.quantile(x[fit, f], np.linspace(0, 1, _BINS + 1)[:-1])) for f in range(x.shape[1])]
    model = Trees(start=float(np.log(y[fit].mean() / (1 - y[fit].mean()))))
    z, grown = np.full(fit.sum(), model.start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(x[fit], y[fit] - p, p * (1 - p), cuts)
        grown.append(tree)
        model.feature, model.cut, model.leaf = (np.stack(t) for t in zip(*grown))
        z += Trees(*(np.stack([t]) for t in tree)).raw(x[fit])
    model.steps = _calibrate(model.raw(x[held]), y[held])
    p = model.probability(x[held])
    for k in range(len(KINDS)):
        own = x[held, 0] == k
        for t in np.unique(p[own]):
            if y[held][own & (p >= t)].mean() >= PRECISION:
                model.threshold[k] = float(t)
                break
    return model


def fit(df: DataFrame, text_col: str = "text", max_docs: int = MAX_DOCS) -> Trees:
    """Learn from the documents of a bounded sample; their features are computed by Spark tasks and trained on in one."""
    texts = df.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    chosen = texts.withColumn("h", F.xxhash64("text")).select("h").distinct().orderBy("h").limit(max_docs)
    rows = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), "h").dropDuplicates(["h"])  # at most max_docs numbers

    def extract(batches):
        for batch in batches:
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
                x, y = examples(text)
                if x:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([h]), pa.array([np.array(x, np.float64).tobytes()], pa.binary()),
                        pa.array([np.array(y, np.int8).tobytes()], pa.binary())], names=["h", "x", "y"])

    def learn(batches):
        import pickle

        rows = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in ("h", "x", "y")))]
        if not rows:
            return
        rows.sort(key=lambda r: r[0])
        labels = [np.frombuffer(y, np.int8) for _, _, y in rows]
        x = np.concatenate([np.frombuffer(v, np.float64).reshape(len(y), -1) for (_, v, _), y in zip(rows, labels)])
        held = np.repeat([h % 10 < 3 for h, _, _ in rows], [len(y) for y in labels])
        model = train(x, np.concatenate(labels).astype(float), held)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = rows.select("h", "text").mapInArrow(extract, "h long, x binary, y binary").coalesce(1).mapInArrow(learn, "model binary").first()
    if made is None:
        return Trees()
    import pickle

    return pickle.loads(made["model"])


# --- search and redaction ----------------------------------------------------------------------------------------------

def added_spans(text: str, base: list[Span], model: Trees) -> list[Span]:
    """Candidates over their kind's threshold, the likeliest first where they overlap."""
    found = candidates(text, base)
    if not found:
        return []
    near = np.array([s[0] for s in base], np.int64)
    p = model.probability(np.array([describe(text, s, near) for s in found], np.float64))
    out: list[Span] = []
    import bisect

    for k in np.argsort(-p, kind="stable"):
        s = found[k]
        if p[k] >= model.threshold[s[2]]:
            i = bisect.bisect_left(out, s)
            if (i == 0 or out[i - 1][1] <= s[0]) and (i == len(out) or out[i][0] >= s[1]):
                out.insert(i, s)
    return out


def search(text: str, model: Trees) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans."""
    if not _HAS.search(text) and " at " not in text.lower() and "at]" not in text.lower() and "at)" not in text.lower():
        return [], []
    base = base_spans(text)
    return base, added_spans(text, base, model)


def find(df: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, n_email, n_ip, n_card, n_phone, base_sha256, spans)``; the counts are those of the base spans, ``spans`` holds all."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # some thousand numbers
    names = [id_col, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]

    def run(batches):
        m = shared.value
        for batch in batches:
            counts, digest, spans = np.zeros((batch.num_rows, len(KINDS)), np.int64), [], []
            for i, text in enumerate(batch.column("text")):
                base, added = search(text.as_py() or "", m)
                for s in base:
                    counts[i, s[2]] += 1
                digest.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(base + added))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c) for c in counts.T.copy()], pa.array(digest, pa.string()),
                                              pa.array(spans, pa.string())], names=names)

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(df: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """``df`` with every span of ``text_col`` replaced by its kind in brackets; null stays null.  Overlapping spans become one, named by the first."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def clean(text: str | None, m: Trees) -> str | None:
        if not text:
            return text
        base, added = search(text, m)
        out, at = [], 0
        for a, b, k in sorted(base + added):
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join(out) + text[at:] if out else text

    def run(batches):
        m = shared.value
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            new = pa.array([clean(t.as_py(), m) for t in batch.column(k)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == k else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)
