"""Secret scans: rules, and a character convolutional network in numpy over every candidate and its surroundings.

Rules find assignments, access ids and hexadecimal runs. The network scores every other run of CANDIDATE characters,
and what the rules' spans leave uncovered in a run, each piece in its place, in windows of WINDOW characters that overlap along the whole run; one whose greatest calibrated probability reaches the
threshold is a further span, of kind ``cnn``. The network is trained from labelled findings made by ``findings`` and
``joined`` and ``parted`` (seeded), the greatest logits of held-out findings are calibrated by a logistic fit, and the threshold is the
highest that keeps RECALL of the held-out secrets.

Defined results: a null text is empty; offsets are code points, ends exclusive; repeated rows are scanned one by one; an
empty table gives an empty result; other columns of documents may have any names.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "cnn")
#: Fixed values of the rules.
_assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
WINDOW = 96  # characters the network sees at a time: up to SEEN of the candidate and what lies on both sides
SEEN = 48
STEP = 24  # characters between a long candidate's windows
BATCH = 256  # windows that go through the network together
CLASSES = 44
FILTERS, WIDTH = 24, 5
RECALL = 0.98
EXAMPLES = 3000
JOINED = 2000  # runs made of several parts, some with a key
PARTED = 2000  # pieces that a rule's span leaves of a run


def _classes() -> np.ndarray:
    """A class for each code below 128: the 26 letters, digits, case, signs; all others share the last."""
    table = np.full(129, CLASSES - 1)
    for c in range(128):
        ch = chr(c)
        table[c] = ord(ch.lower()) - 97 if ch.isalpha() else 26 if ch.isdigit() else 27 if ch in " \t" else 28 if ch in "\r\n" else 29 + "\"'=:+/_.-@#$%&,;".find(ch) if ch in "\"'=:+/_.-@#$%&,;" else CLASSES - 2
    return table


_class = _classes()


def places(a: int, b: int) -> list[int]:
    """Where the windows of a candidate begin: they overlap, and the last ends with it."""
    return [*range(a, b - SEEN, STEP), b - SEEN] if b - a > SEEN else [a]


def pieces(texts: list[str], spans: list[tuple[int, int]]):
    """(number of the candidate, its text, its end, where the window begins) of all windows."""
    for k, (text, (a, b)) in enumerate(zip(texts, spans)):
        for low in places(a, b):
            yield k, text, b, low


def seen(windows: list) -> tuple[np.ndarray, np.ndarray]:
    """Character classes (n, WINDOW), and flags (n, WINDOW, 3): within the candidate, upper case, digit."""
    side = (WINDOW - SEEN) // 2
    codes, flags = np.full((len(windows), WINDOW), 32), np.zeros((len(windows), WINDOW, 3), np.float32)
    for k, (_, text, b, a) in enumerate(windows):
        mid = min(b, a + SEEN)
        left, rest = text[max(0, a - side) : a], text[a : a + WINDOW - side]
        at = side - len(left)
        raw = np.frombuffer((left + rest).encode("utf-32-le", "surrogatepass"), "<u4")
        codes[k, at : at + len(raw)] = np.minimum(raw, 128)
        flags[k, side : side + mid - a, 0] = 1
    flags[:, :, 1] = (codes >= 65) & (codes <= 90)
    flags[:, :, 2] = (codes >= 48) & (codes <= 57)
    return _class[codes], flags


def windows(texts: list[str], spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes and flags of all windows, and the number of each window's candidate."""
    made = list(pieces(texts, spans))
    return (*seen(made), np.array([k for k, *_ in made], np.int64))


def _columns(classes: np.ndarray, flags: np.ndarray) -> np.ndarray:
    x = np.concatenate([np.eye(CLASSES, dtype=np.float32)[classes], flags], 2)
    seen = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)  # n, places, channels, width
    return seen.transpose(0, 1, 3, 2).reshape(len(x), WINDOW - WIDTH + 1, -1)


class Network:
    """Convolution, rectifier, maximum and mean over places, one logistic unit; then a calibrated probability."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        n = WIDTH * (CLASSES + 3)
        self.w = {"conv": (r.standard_normal((n, FILTERS)) * (2 / n) ** 0.5).astype(np.float32), "bias": np.zeros(FILTERS, np.float32), "out": (r.standard_normal(2 * FILTERS) * 0.1).astype(np.float32), "b": np.zeros(1, np.float32)}
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray):
        h = np.maximum(x @ self.w["conv"] + self.w["bias"], 0)
        top = h.argmax(1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)], 1)
        return h, top, pooled, pooled @ self.w["out"] + self.w["b"][0]

    def logits(self, classes: np.ndarray, flags: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The greatest logit of each candidate's windows."""
        best = np.full(owner.max(initial=-1) + 1, -np.inf)
        for at in range(0, len(owner), BATCH):
            np.maximum.at(best, owner[at : at + BATCH], self.forward(_columns(classes[at : at + BATCH], flags[at : at + BATCH]))[3])
        return best

    def probability(self, classes: np.ndarray, flags: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(classes, flags, owner) + self.shift, -40, 40)))

    def judge(self, texts: list[str], spans: list[tuple[int, int]]) -> np.ndarray:
        """The probability of each candidate; no more than BATCH windows are held at once."""
        best, todo = np.zeros(len(spans)), pieces(texts, spans)
        while made := list(itertools.islice(todo, BATCH)):
            own, owner = np.unique([k for k, *_ in made], return_inverse=True)
            best[own] = np.maximum(best[own], self.probability(*seen(made), owner))
        return best

    def train(self, classes, flags, labels, passes: int = 6, batch: int = 64, rate: float = 3e-3, seed: int = 5) -> None:
        r, t = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for _ in range(passes):
            order = r.permutation(len(labels))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                x = _columns(classes[pick], flags[pick])
                h, top, pooled, z = self.forward(x)
                d = (1 / (1 + np.exp(-z)) - labels[pick]) / len(pick)
                dp = d[:, None] * self.w["out"]
                dh = np.repeat(dp[:, None, FILTERS:] / h.shape[1], h.shape[1], 1)
                np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + dp[:, None, :FILTERS], 1)
                dh *= h > 0
                g = {"conv": x.reshape(-1, x.shape[2]).T @ dh.reshape(-1, FILTERS), "bias": dh.sum((0, 1)), "out": pooled.T @ d, "b": d.sum()[None]}
                t += 1
                for k in self.w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def calibrate(self, classes, flags, owner, labels) -> None:
        z = self.logits(classes, flags, owner)
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps of a logistic fit with a little ridge
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
            g = np.array([((p - labels) * z).sum() + 1e-2 * (a - 1), (p - labels).sum() + 1e-2 * b])
            q = p * (1 - p)
            a, b = np.array([a, b]) - np.linalg.solve(np.array([[(q * z * z).sum() + 1e-2, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-2]]), g)
        self.slope, self.shift = float(a), float(b)
        found = np.sort(self.probability(classes, flags, owner)[labels == 1])
        self.threshold = float(found[int((1 - RECALL) * len(found))])


#: Parts of made-up words of several languages.
ONSETS = "b c d f g h j k l m n p r s t v w z bl br ch cl cr dr fl fr gl gr kn pl pr qu sch sh sk sl sp st str th tr tsch".split() + [""] * 8
VOWELS = "a e i o u a e i o u ai au ea ee ei eu ie io oo ou y".split()
CODAS = "n r s t l m d ck ch cht ft ld mp nd ng nk nt rd rk rn rt ss st tz ngs ght".split() + [""] * 20


def findings(n: int = EXAMPLES, seed: int = 11) -> list[tuple[str, tuple[int, int], int]]:
    """Labelled findings: (text, candidate's span, 1 for a secret). Half are keys of many forms; the rest are card and phone
    numbers, host names, dates, paths, version strings, long and compound words. Runs of digits of a card's or a phone
    number's length are no secrets, much longer ones are."""
    r = random.Random(seed)
    word = lambda a=2, b=9: "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "de", "la", "que", "sch", "ge", "ei", "ou", "os", "ci", "a", "o", "e"]) for _ in range(r.randint(a, b) // 2 + 1))
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    full = string.ascii_letters + string.digits
    sound = lambda: r.choice(ONSETS) + r.choice(VOWELS) + r.choice(CODAS)
    compound = lambda n: "".join(sound() for _ in range(n))
    secret = [
        lambda: pick(full, r.randint(20, 64)), lambda: pick(full + "+/", r.randint(24, 64)) + "=" * r.randint(0, 2), lambda: r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-", "npm_", "pk_test_"]) + pick(full, r.randint(20, 40)),
        lambda: "eyJ" + pick(full, 20) + "." + pick(full, 24) + "." + pick(full + "_-", 30), lambda: "AIza" + pick(full + "_-", 35), lambda: pick("0123456789abcdef", r.choice([32, 40, 64])), lambda: pick("0123456789ABCDEF", r.choice([32, 40])), lambda: pick(full + "_-", r.randint(22, 44)),
        lambda: pick(string.ascii_lowercase, r.choice([16, 16, r.randint(17, 48)])), lambda: pick(string.ascii_uppercase, r.randint(16, 48)), lambda: pick(string.digits, r.randint(28, 64)),
    ]
    plain = [
        lambda: pick(string.digits, r.randint(16, 22)), lambda: ".".join(word() for _ in range(4)) + ".com", lambda: "mail" + pick(string.digits, 1) + "." + word(6) + ".example.com", lambda: "-".join(word() for _ in range(r.randint(3, 6))), lambda: word(18, 40),
        lambda: word(18, 30).upper(), lambda: "/".join(word() for _ in range(4)) + ".html", lambda: f"20{pick('012', 1)}{pick(string.digits, 1)}-0{pick('123456789', 1)}-1{pick(string.digits, 1)}T0{pick(string.digits, 1)}", lambda: "_".join(word() for _ in range(4)), lambda: r.choice("-=_.") * r.randint(16, 60),
        lambda: "+" + "-".join(pick(string.digits, 4) for _ in range(4)), lambda: ".".join(pick(string.digits, r.randint(1, 3)) for _ in range(6)), lambda: word(8, 20) + word(8, 20).capitalize() + pick(string.digits, 1), lambda: word(4, 9) + "." + pick(string.digits, 2) + "-mail" + pick(string.digits, 1) + ".example.com",
        lambda: f"{pick('0123456789abcdef', 4)}.{word()}.{word()}.{pick(string.digits, 3)}", lambda: "www." + word(8, 14) + pick(string.digits, 2) + ".example.org/" + word() + "/" + pick(string.digits, 3),
    ]
    plain += [lambda: compound(r.randint(4, 9)), lambda: compound(r.randint(4, 9)).capitalize(), lambda: compound(r.randint(4, 9)).upper(), lambda: compound(r.randint(4, 7)) + r.choice(".-_=/"), lambda: word(18, 40).capitalize(), lambda: word(16, 40) + r.choice(".-_=/")]
    out = []
    for k in range(n):
        label = k % 2
        body = ""
        while len(body) < 16:
            body = r.choice(secret if label else plain)()
        left = " ".join(word() for _ in range(r.randint(0, 8))) + r.choice([" ", " ", " key = \"", " auth: ", "\n", " ", "=", " bearer ", " ("])
        right = r.choice([" ", "\"", ".\n", ", ", "'"]) + " ".join(word() for _ in range(r.randint(0, 8)))
        out.append((left + body + right, (len(left), len(left) + len(body)), label))
    return out


def joined(n: int = JOINED, seed: int = 17) -> list[tuple[str, tuple[int, int], tuple[int, int] | None]]:
    """Long runs: (text, run, where its key is or None). Plain findings joined as paths, dotted names and settings, every
    second one with a key somewhere among them."""
    r = random.Random(seed)
    made = findings(4 * n, seed)
    keys, plain = ([t[a:b] for t, (a, b), y in made if y == label] for label in (1, 0))
    words = [x for x in plain if any(c.isalpha() for c in x)]
    out = []
    for k in range(n):
        sign, parts = r.choice("/._-"), [r.choice(words) for _ in range(r.randint(2, 6))]
        at = r.choice([len(parts), r.randint(0, len(parts))]) if k % 2 else None
        key = r.choice(keys) if k % 2 else ""
        before = sign.join(parts[:at])
        before += (r.choice(["=", sign]) if before and k % 2 else "")
        after = sign + sign.join(parts[at:]) if k % 2 and at < len(parts) else ""
        left, right = made[k][0][: made[k][1][0]], made[k][0][made[k][1][1] :]
        start = len(left) + len(before)
        out.append((left + before + key + after + right, (len(left), start + len(key) + len(after)), (start, start + len(key)) if key else None))
    return out


def parted(n: int = PARTED, seed: int = 19) -> list[tuple[str, tuple[int, int], tuple[int, int] | None]]:
    """Pieces that a rule's span leaves of a run: (text, piece, the piece if it is of a key, else None)."""
    r = random.Random(seed)
    made = findings(n, seed)
    out = []
    for k, (text, (a, b), label) in enumerate(made):
        rule = r.choice([lambda: "AKIA" + "".join(r.choice(string.ascii_uppercase + string.digits) for _ in range(16)), lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([24, 32, 40])))])()
        body, sign = text[a:b], r.choice("/_.=-")
        if k % 4 < 2:  # a whole one before or after the rule's span
            before, after = r.choice([(body + sign, ""), ("", sign + body)])
        else:  # or one that the rule's span parts
            at = r.randint(1, len(body) - 1)
            before, after = body[:at], body[at:]
            if not label:
                before, after = before + sign, sign + after
        one = text[:a] + before + rule + after + text[b:]
        left, right = (a, a + len(before)), (a + len(before) + len(rule), a + len(before) + len(rule) + len(after))
        piece = left if before and (not after or r.random() < 0.5) else right
        out.append((one, piece, piece if label else None))
    return out


def window_labels(spans: list[tuple[int, int]], keys: list) -> np.ndarray:
    """Of each window 1 if it shows a key or 16 characters of one, 0 if it shows nothing of it, -1 between."""
    out = []
    for (a, b), key in zip(spans, keys):
        for low in places(a, b):
            shown = min(b, low + SEEN, key[1]) - max(low, key[0]) if key else 0
            out.append(0 if shown <= 0 else 1 if shown >= min(16, key[1] - key[0]) else -1)
    return np.array(out)


_network: Network | None = None


def network() -> Network:
    """The trained network: from the same findings and seeds in every process."""
    global _network
    if _network is None:
        made = [(t, span, span if y else None) for t, span, y in findings()] + joined() + parted()
        random.Random(13).shuffle(made)
        cut = len(made) * 3 // 4
        texts, spans, keys = zip(*made)
        net = Network()
        classes, flags, _ = windows(texts[:cut], spans[:cut])
        labels = window_labels(spans[:cut], keys[:cut])
        net.train(classes[labels >= 0], flags[labels >= 0], labels[labels >= 0].astype(np.float32), passes=14)
        net.calibrate(*windows(texts[cut:], spans[cut:]), np.array([k is not None for k in keys[cut:]], np.float32))
        _network = net
    return _network


def rules(text: str, runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The rules' spans: leftmost, not overlapping within a kind, those too short dropped. runs: of CANDIDATE, which hold all long hexadecimal runs and access ids."""
    out = []
    low = text.lower() if ":" in text or "=" in text else ""
    if any(x in low for x in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        out += [("assign", m.start(), m.end()) for m in _assign.finditer(text) if len(m[2]) >= LEAST["assign"]]
    for a, b in runs:
        if b - a >= LEAST["access"]:
            out += [("access", m.start(), m.end()) for m in _access.finditer(text, a, b) if m.end() - m.start() >= LEAST["access"]]
        if b - a >= LEAST["hex"]:
            out += [("hex", m.start(), m.end()) for m in _hex.finditer(text, a, b) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def uncovered(a: int, b: int, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What the rules' spans, in order of their start, leave of a run: itself, or pieces of any length."""
    out = []
    for _, x, y in base:
        if x < b and a < y:
            if a < x:
                out.append((a, x))
            a = max(a, y)
    return out + [(a, b)] * (a < b)


def scan(texts: list[str], net: Network) -> list[list[tuple[str, int, int]]]:
    """All spans of each text, by start and kind. Candidates of all texts go through the network together."""
    found, where, of, spans = [], [], [], []
    for k, text in enumerate(texts):
        runs = [m.span() for m in CANDIDATE.finditer(text)]
        base = rules(text, runs)
        found.append(base)
        for run in runs:
            for a, b in uncovered(*run, base):
                where.append((k, a, b))
                of.append(text)
                spans.append((a, b))
    for (k, a, b), one in zip(where, net.judge(of, spans)):
        if one >= net.threshold:
            found[k].append(("cnn", a, b))
    return [sorted(x, key=lambda s: (s[1], KINDS.index(s[0]))) for x in found]


def spans(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end), of every document."""
    net = net or network()

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            got = scan([x.as_py() or "" for x in batch.column(1)], net)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"kind": a, "start": b, "end": c} for a, b, c in x] for x in got], kind)], ["doc_id", "spans"])

    common.arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, net: Network | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by a mark, and n_chars (if there is one) counted anew; other columns as they are."""
    net = net or network()
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [x.as_py() for x in batch.column(at)]
            for k, found in enumerate(scan([x or "" for x in texts], net)):
                if found:
                    out, upto = [], 0
                    for _, a, b in found:
                        if b > upto:
                            out += [texts[k][upto:a], mark] if a >= upto else []
                            upto = b
                    texts[k] = "".join(out) + texts[k][upto:]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if chars is not None:
                columns[chars] = pa.array([c if x is None else len(x) for x, c in zip(texts, batch.column(chars).to_pylist())], batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    common.arrow_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = spans(common.table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "cnn")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(F.encode(said(base), "UTF-8"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), of("cnn").alias("n_cnn"))
