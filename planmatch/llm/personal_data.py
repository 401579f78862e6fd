"""Personal data in texts: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field labels words from features of their shape and of their neighbours' shapes. It is trained here on a small labelled table made
by seeded templates (forward-backward gradients in numpy), and decoded by Viterbi over many sequences at once. A sequence is a stretch of
words in which no more than ``REACH`` words in a row lack a digit, an at sign or an equals sign: words farther from any such word are other text by
definition, so that the field runs only near them. What is spelt without any of these (``name at host dot com``, a password without its name) stays outside. Spans that the field finds are added where they overlap no
span of the patterns; those always stay.

The patterns are searched in time that grows with the text alone: e-mail addresses from each at sign, numbers with dots by whole chains of them.

Defined results: null text counts as empty and has no span; offsets are code points, ends exclusive; repeated rows are read each by
itself; other columns are passed on, whatever their names, but for the text and those named as results; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planmatch.llm.names import unused
from planmatch.llm.words import raw, slices

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["other", *KINDS, "secret"]
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
REACH = 3


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign: the run of local characters before it, as far back as the last match or at sign, and a domain behind it."""
    last = before = 0
    at = text.find("@")
    while at >= 0:
        run = text[max(last, before) : at]
        start = at - (len(run) - len(run.rstrip(LOCAL)))
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            last = domain.end()
        before = at + 1
        at = text.find("@", max(before, last))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers each from the start of every chain of numbers with single dots between, those with a part above 255 dropped."""
    for m in CHAIN.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[i : i + 4])) + 3
            if all(len(p) <= 3 and int(p) <= 255 or len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[i : i + 4]):
                yield at, end
            at = end + 1


def numbers(pattern: re.Pattern, text: str, holds) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text):
        if holds(m.group().translate(NOT_DIGITS)):
            yield m.span()


NOT_DIGITS = str.maketrans("", "", " -+().")
#: What a text must hold for a kind to occur in it, and its spans.
PATTERNS = {
    "email": ("@", emails), "ip": (".", addresses), "card": ("", lambda t: numbers(CARD, t, lambda d: 16 <= len(d) <= 19 and luhn(d))), "phone": ("+", lambda t: numbers(PHONE, t, lambda d: 8 <= len(d) <= 15)),
}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, by kind, then start."""
    return [(kind, a, b) for kind, (sign, search) in PATTERNS.items() if sign in text for a, b in search(text)]


# ---------------------------------------------------------------- features of a word's shape


@functools.lru_cache(1 << 16)
def short_shape(word: str) -> tuple[str, ...]:
    return plain_shape(word)


def shape(word: str) -> tuple[str, ...]:
    """Features of a word; those of long words aren't kept."""
    return short_shape(word) if len(word) <= 64 else plain_shape(word)


def plain_shape(word: str) -> tuple[str, ...]:
    body = word.strip(".,;:!?\"'()[]{}<>")
    digits = sum(c.isdigit() for c in word)
    runs = re.sub(r"[A-Z]+", "A", re.sub(r"[^\W\d_A-Z]+", "a", re.sub(r"\d+", "9", body)))
    level = next(i for i, top in enumerate((0, 1, 3, 4, 7, 12, 15, 19, 10**9)) if digits <= top)
    out = [f"digits={level}", f"length={min(len(body), 40) // 4}", f"runs={runs if len(runs) <= 9 else 'long'}", f"first={word[:1] if not word[:1].isalnum() else '-'}"]
    out += [f"dots={min(body.count('.'), 4)}"]
    out += [name for name, on in (
        ("at", "@" in body), ("equals", "=" in body), ("quoted", word[:1] == '"'), ("dash", "-" in body), ("only-digits", body.isdigit()), ("upper", body.isupper()),
        ("hex", len(body) >= 16 and re.fullmatch(r"[0-9a-f]+", body) is not None), ("key", len(body) >= 16 and body.isalnum() and body.isupper() and 0 < digits < len(body)),
        ("named", re.match(r"(?i)[\w-]*(password|passwd|secret|token|api_?key)\b", body) is not None), ("byte-parts", re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", body) is not None),
    ) if on]
    return tuple(out)


def features(before: tuple[str, ...], own: tuple[str, ...], after: tuple[str, ...]) -> list[str]:
    """Of a word, by its shape and those of its neighbours."""
    return ["bias", *own, *("-1 " + x for x in before if x[:5] != "lengt"), *("+1 " + x for x in after if x[:5] != "lengt")]


def word_features(words: list[str]) -> list[list[str]]:
    shapes = [("start",), *map(shape, words), ("end",)]
    return [features(*shapes[i : i + 3]) for i in range(len(words))]


# ---------------------------------------------------------------- the labelled table


def labelled(count: int = 700, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """Sequences of words with their labels, by seeded templates."""
    rng = np.random.default_rng(seed)
    syllables = "an er on in the re st en th ou ed ing ble ion ver ung keit que eau ó ñas mente ción ée ß ü".split()
    pick = lambda x: x[int(rng.integers(len(x)))]
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    some = lambda chars, n: "".join(pick(chars) for _ in range(n))

    def word() -> str:
        w = "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
        return (w.capitalize() if rng.random() < 0.15 else w) + (pick(",.;:") if rng.random() < 0.15 else "")

    def card() -> str:
        body = pick("3456") + digits(14)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def phone() -> str:
        d = digits(3), digits(3), digits(4)
        return pick([f"+{digits(1)} ({d[0]}) {d[1]}-{d[2]}", f"({d[0]}) {d[1]}-{d[2]}", f"+{digits(2)} {d[0]} {d[1]}{d[2]}", f"+{digits(2)}{d[0]}{d[1]}{d[2]}", f"{d[0]}-{d[1]}-{d[2]}", f"+{digits(2)} {d[0]}-{d[1]}-{d[2]}"])

    name = lambda: "".join(pick(["an", "er", "ou", "mi", "lo", "ka"]) for _ in range(3))
    makers = {
        "email": lambda: f"{name()}{pick(['', '.', '_'])}{pick(['', name(), digits(2)])}@{pick([name(), 'mail' + digits(1)])}{pick(['', '.example'])}.{pick(['com', 'org', 'net', 'de'])}",
        "ip": lambda: ".".join(str(x) for x in rng.integers(1, 256, 4)),
        "card": lambda: pick([str, lambda c: " ".join(c[i : i + 4] for i in range(0, 16, 4)), lambda c: "-".join(c[i : i + 4] for i in range(0, 16, 4))])(card()),
        "phone": phone,
        "secret": lambda: pick([lambda: "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: "password=" + some("0123456789abcdef", 18), lambda: '"' + some("0123456789abcdef", 40) + '"',
                                lambda: some("0123456789abcdef", 32), lambda: "api_key=" + some("abcdefghijkLMNOPQRS0123456789", 24), lambda: pick(["password=", "passwd=", "secret="]) + name() + name()])(),
    }
    plain = [
        lambda: digits(1) + ".", lambda: "4.0.", lambda: digits(4), lambda: str(rng.integers(1, 100)), lambda: digits(2) + "%", lambda: f"{digits(1)}.{digits(2)}", lambda: digits(1) + "," + digits(3), lambda: "(" + digits(4) + ")",
        lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: "v" + digits(1) + "." + digits(1) + "." + digits(1), lambda: pick("ABC") + digits(2), lambda: "@" + name(), lambda: digits(6), lambda: f"${digits(3)}.{digits(2)}", lambda: digits(2) + "th",
        lambda: f"{digits(1)}-{digits(1)}", lambda: pick(["covid", "mp", "b"]) + "-" + digits(2),
        lambda: name() + "=" + name(), lambda: pick("xyz") + "=" + digits(1), lambda: "=", lambda: name() + "=" + digits(2), lambda: "==",
    ]
    out = []
    for _ in range(count):
        words, labels = [], []
        for _ in range(int(rng.integers(1, 4))):
            lead = int(rng.integers(0, REACH + 1))
            words += [word() for _ in range(lead)]
            labels += ["other"] * lead
            if rng.random() < 0.5:
                kind = pick(list(makers))
                value = makers[kind]()
                if value[0] == '"' and rng.random() < 0.8:
                    words += ["token", "="]
                    labels += ["other"] * 2
                parts = value.split(" ")
                parts[-1] += pick(",.;") if rng.random() < 0.15 else ""
                words += parts
                labels += [kind] * len(parts)
            else:
                words.append(pick(plain)())
                labels.append("other")
        tail = int(rng.integers(0, REACH + 1))
        words += [word() for _ in range(tail)]
        out.append((words, labels + ["other"] * tail))
    return out


# ---------------------------------------------------------------- the field


def summed(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def padded(lengths: np.ndarray) -> np.ndarray:
    """Place of word t of sequence b in the list of all words; -1 past its end."""
    first = np.cumsum(lengths) - lengths
    t = np.arange(lengths.max() if len(lengths) else 0)
    return np.where(t[None] < lengths[:, None], first[:, None] + t[None], -1)


@functools.cache
def trained(rounds: int = 220, rate: float = 0.3, ridge: float = 3e-4) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Feature numbers, weights by feature and label, and weights of label pairs; maximum likelihood by Adam."""
    rows = labelled()
    features = [f for words, _ in rows for f in word_features(words)]
    names: dict[str, int] = {}
    for f in chain.from_iterable(features):
        names.setdefault(f, len(names))
    k, n = len(LABELS), len(features)
    matrix = np.zeros((n, len(names)), np.float32)
    for i, f in enumerate(features):
        matrix[i, [names[x] for x in f]] = 1
    gold = np.array([LABELS.index(x) for _, labels in rows for x in labels])
    at = padded(np.array([len(w) for w, _ in rows]))
    inside = at >= 0
    truth = np.zeros((n, k))
    truth[np.arange(n), gold] = 1
    pairs = np.zeros((k, k))
    np.add.at(pairs, (gold[at[:, :-1]][inside[:, 1:]], gold[at[:, 1:]][inside[:, 1:]]), 1)
    theta = [np.zeros((len(names), k)), np.zeros((k, k))]
    moment = [[np.zeros_like(x), np.zeros_like(x)] for x in theta]
    b, t = at.shape
    for step in range(1, rounds + 1):
        scores = (matrix @ theta[0].astype(np.float32)).astype(float)
        e = np.where(inside[..., None], scores[at], 0)
        alpha, beta = np.zeros((b, t, k)), np.zeros((b, t, k))
        alpha[:, 0] = e[:, 0]
        for i in range(1, t):
            alpha[:, i] = np.where(inside[:, i, None], summed(alpha[:, i - 1, :, None] + theta[1], 1) + e[:, i], alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            beta[:, i] = np.where(inside[:, i + 1, None], summed(theta[1] + (e[:, i + 1] + beta[:, i + 1])[:, None], 2), beta[:, i + 1])
        z = summed(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None])[inside]
        edge = np.exp(alpha[:, :-1, :, None] + theta[1] + (e[:, 1:] + beta[:, 1:])[:, :, None] - z[:, None, None, None])[inside[:, 1:]].sum(0)
        order = at[inside]
        expected = np.zeros((n, k))
        expected[order] = node
        slopes = [matrix.T @ (truth - expected).astype(np.float32) / n - ridge * theta[0], (pairs - edge) / n - ridge * theta[1]]
        for x, g, (m, v) in zip(theta, slopes, moment):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return names, theta[0], theta[1]


#: Words from which a sequence is decoded in parts, and words of a part.
LONG, PART = 4096, 512


def viterbi(scores: np.ndarray, lengths: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Best labels of all words of all sequences, decoded side by side; long ones by parts."""
    out = np.zeros(len(scores), np.int64)
    order = np.argsort(lengths, kind="stable")
    first = np.cumsum(lengths) - lengths
    for i in np.flatnonzero(lengths >= LONG):
        out[first[i] : first[i] + lengths[i]] = viterbi_by_parts(scores[first[i] : first[i] + lengths[i]], pairs)
    order = order[lengths[order] < LONG]
    for a in range(0, len(order), 1024):
        chosen = order[a : a + 1024]
        n = lengths[chosen]
        at = np.where(np.arange(n.max())[None] < n[:, None], first[chosen][:, None] + np.arange(n.max())[None], -1)
        best = scores[at[:, 0]]
        back = np.zeros((*at.shape, scores.shape[1]), np.int8)
        for t in range(1, at.shape[1]):
            ways = best[:, :, None] + pairs
            back[:, t] = ways.argmax(1)
            best = np.where((at[:, t] >= 0)[:, None], ways.max(1) + scores[at[:, t]], best)
        label = best.argmax(1)
        rows = np.arange(len(chosen))
        for t in range(at.shape[1] - 1, -1, -1):
            on = at[:, t] >= 0
            out[at[on, t]] = label[on]
            if t:
                label = np.where(on, back[rows, t, label], label)
    return out


def viterbi_by_parts(scores: np.ndarray, pairs: np.ndarray, part: int = PART) -> np.ndarray:
    """Best labels of one sequence: for all parts side by side the best score from each label before a part to each label at its end, which are
    chained part by part; then all parts side by side again, between the labels that they are now known to have at their ends."""
    n, k = scores.shape
    parts = -(-(n - 1) // part)
    if not parts:
        return scores.argmax(1)
    at = 1 + np.arange(parts * part).reshape(parts, part)
    inside = at < n
    at = np.minimum(at, n - 1)
    whole = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(parts, 0)
    for t in range(part):
        on = inside[:, t]
        step = (whole[on][:, :, :, None] + pairs).max(2)
        whole[on] = step + scores[at[on, t]][:, None]
    best, came = scores[0], np.zeros((parts, k), np.int64)
    for p in range(parts):
        ways = best[:, None] + whole[p]
        came[p] = ways.argmax(0)
        best = ways.max(0)
    ends = np.zeros(parts + 1, np.int64)
    ends[-1] = best.argmax()
    for p in range(parts - 1, -1, -1):
        ends[p] = came[p, ends[p + 1]]
    best = np.full((parts, k), -np.inf)
    best[np.arange(parts), ends[:-1]] = 0
    back = np.zeros((part, parts, k), np.int8)
    for t in range(part):
        ways = best[:, :, None] + pairs
        back[t] = ways.argmax(1)
        best = np.where(inside[:, t, None], ways.max(1) + scores[at[:, t]], best)
    out = np.zeros(n, np.int64)
    label, rows = ends[1:].copy(), np.arange(parts)
    for t in range(part - 1, -1, -1):
        on = inside[:, t]
        out[at[on, t]] = label[on]
        label = np.where(on, back[t, rows, label], label)
    out[0] = ends[0]
    return out


def sequences(text: str) -> list[list[tuple[int, int]]]:
    """Stretches of words near a digit, an at sign or an equals sign, as spans."""
    out: list[list[tuple[int, int]]] = []
    last = -(10**9)
    held: list[tuple[int, int]] = []
    for i, m in enumerate(WORD.finditer(text)):
        w = m.group()
        if any(map(w.__contains__, "@=0123456789")):
            if i - last > 2 * REACH:
                out.append(held[-REACH:])
            else:
                out[-1] += held
            out[-1].append(m.span())
            last, held = i, []
        else:
            held.append(m.span())
            if i - last == REACH:
                out[-1] += held
                held = []
            elif len(held) > 4 * REACH:
                held = held[-REACH:]
    if out and held and i - last < REACH:
        out[-1] += held
    return out


def scored(sequences: list[list[str]], names: dict[str, int], weights: np.ndarray) -> np.ndarray:
    """Scores of the labels of all words, which depend on the shapes of a word and its neighbours: each three shapes are scored once."""
    numbers: dict[tuple[str, ...], int] = {("start",): 0, ("end",): 1}
    own = np.array([numbers.setdefault(shape(w), len(numbers)) for s in sequences for w in s])
    ends = np.cumsum([len(s) for s in sequences])
    before, after = np.roll(own, 1), np.roll(own, -1)
    before[ends - [len(s) for s in sequences]], after[ends - 1] = 0, 1
    many = len(numbers)
    three, place = np.unique((before * many + own) * many + after, return_inverse=True)
    shapes = list(numbers)
    flat, at = [], []
    for code in three.tolist():
        a, b, c = code // many // many, code // many % many, code % many
        known = [names[x] for x in features(shapes[a], shapes[b], shapes[c]) if x in names]
        flat += known
        at.append(len(known))
    return np.add.reduceat(weights[flat], np.cumsum([0, *at[:-1]]), axis=0)[place]


def field_spans(texts: list[str], model) -> list[list[tuple[str, int, int]]]:
    """Spans that the field finds in each text: neighbours of one label joined, punctuation around them left out."""
    names, weights, pairs = model
    found = [(t, s) for t, text in enumerate(texts) for s in sequences(text)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not found:
        return out
    lengths = np.array([len(s) for _, s in found])
    labels = viterbi(scored([[texts[t][a:b] for a, b in s] for t, s in found], names, weights), lengths, pairs)
    place = 0
    for (t, s), n in zip(found, lengths):
        own = labels[place : place + n]
        place += n
        i = 0
        while i < n:
            j = i + 1
            while j < n and own[j] == own[i]:
                j += 1
            if own[i]:
                a, b = s[i][0], s[j - 1][1]
                while b > a and texts[t][b - 1] in ".,;:!?\"')]}>":
                    b -= 1
                while a < b and texts[t][a] in "\"'[{<" + ("" if LABELS[own[i]] == "phone" else "("):
                    a += 1
                if b > a:
                    out[t].append((LABELS[own[i]], a, b))
            i = j
    return out


def all_spans(texts: list[str], model) -> list[tuple[list, list]]:
    """Spans of the patterns, and all spans with what the field adds; both by kind, then start."""
    out = []
    for text, more in zip(texts, field_spans(texts, model)):
        base = base_spans(text)
        extra = [x for x in more if all(x[2] <= a or b <= x[1] for _, a, b in base)]
        out.append((base, sorted([*base, *extra], key=lambda x: (LABELS.index(x[0]), x[1]))))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in square brackets; of overlapping spans the union, named for the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def suspects(column: pa.Array) -> np.ndarray:
    """Rows with a digit, an at sign or an equals sign."""
    body, at = raw(column)
    if not len(body):
        return np.zeros(0, np.int64)
    hit = np.flatnonzero(((body >= 0x30) & (body <= 0x39)) | (body == 0x40) | (body == 0x3D))
    return np.unique(np.searchsorted(at, hit, side="right") - 1)


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with n_email, n_ip, n_card, n_phone, base_spans, spans, redacted_text, added or replaced."""
    own = [*(f"n_{k}" for k in KINDS), "base_spans", "spans", "redacted_text"]
    keep = [c for c in docs.columns if c.lower() not in own and c != text]
    (source,) = unused([*keep, *own], "source_text")
    docs = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(source))
    model = trained()
    kinds = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]), *(f"n_{k} long" for k in KINDS), "base_spans string", "spans string", "redacted_text string"]

    def go(batches):
        for batch in slices(batches, source):
            column = batch.column(source)
            rows = suspects(column).tolist()
            texts = [column[i].as_py() for i in rows]
            found = dict(zip(rows, all_spans(texts, model)))
            counts = {k: np.zeros(batch.num_rows, np.int64) for k in KINDS}
            for i, (base, _) in found.items():
                for k, _, _ in base:
                    counts[k][i] += 1
            clean = {i: redacted(x, found[i][1]) for i, x in zip(rows, texts)}
            whole = column.fill_null("").to_pylist() if rows else None
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep), *(pa.array(counts[k]) for k in KINDS),
                    pa.array([joined(found[i][0]) if i in found else "" for i in range(batch.num_rows)]), pa.array([joined(found[i][1]) if i in found else "" for i in range(batch.num_rows)]),
                    pa.array([clean.get(i, x) for i, x in enumerate(whole)], pa.string()) if rows else column.fill_null("").cast(pa.string()),
                ],
                names=[*keep, *own],
            )

    return docs.mapInArrow(go, ", ".join(kinds))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")
