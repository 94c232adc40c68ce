"""Personal data: fixed patterns, and spans that a BiLSTM-CRF over characters adds to them.

The tagger reads windows of 64 characters, one every 32.  A character takes its tag from the window in whose middle half it
lies, so the tags of overlapping windows join to one sequence over the whole text.  A span must hold a digit or ``@``, and an
e-mail lies in the run of address characters and spaces on both sides of its ``@``, so only windows that hold a digit or touch
such a run are run.  Which part of a long address a window shows depends on its place in the text, so each ``@`` is also read
in a window of its own around it, ``ASIDE`` characters to each side, whose e-mail over that ``@`` holds.  Added spans pass the same checks as those of the patterns (digits,
check sum, parts) and never overlap a span of the patterns.

The tagger is trained on spans of the patterns in a bounded sample of the documents and on spans written in further ways
(spaces around marks, other separators, no plus sign), labelled by construction.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import per_block, texts_of
from trackloom.llm.tagger import KINDS, PAD, WINDOW, Tagger, codes

#: Documents read for training, the first ones in the order of a hash of their id.
TRAIN_DOCUMENTS = 4_000
TRAIN_WINDOWS = 6_000
WRITTEN_WINDOWS = 6_000
STEPS = 300
STRIDE = WINDOW // 2
#: Windows that are decoded together.
TOGETHER = 512
#: Characters to each side of an @ in its own window, as many as a local part may have.
ASIDE = 64

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A part that begins inside a run of digits matches exactly if one from the run's start does.
ADDRESS = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
#: What may lie before and after the @ of an e-mail that is spelled apart; an @ ends the run of its neighbour.
BEFORE, AFTER = LOCAL | {" "}, re.compile(r"[A-Za-z0-9. -]*")
Span = tuple[str, int, int]


def passes_check_sum(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if n % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid_address(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def valid_card(text: str) -> bool:
    digits = digits_of(text)
    return 13 <= len(digits) <= 19 and passes_check_sum(digits)


def valid_phone(text: str) -> bool:
    return 9 <= len(digits_of(text)) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from each @ the longest local part to its left that no match before it took."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            found.append((begin, free := domain.end()))
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the patterns, by kind and start."""
    found: list[Span] = [("email", a, b) for a, b in emails(text)]
    if TRIGGER.search(text):
        found += [("ip", *m.span()) for m in ADDRESS.finditer(text) if valid_address(m[0].split("."))]
        found += [("card", *m.span()) for m in CARD.finditer(text) if valid_card(m[0])]
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if valid_phone(m[0])]
    return found


def window_starts(text: str) -> np.ndarray:
    """Starts of the windows that hold a digit or @."""
    places = np.fromiter((m.start() for m in TRIGGER.finditer(text)), np.int64)
    block = places // STRIDE
    return np.unique(np.concatenate([block, block - 1])).clip(0) * STRIDE if len(places) else places


def address_runs(text: str) -> list[tuple[int, int, int]]:
    """(@, begin, end) of the run around each @ that an e-mail over it can't leave."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in BEFORE:
            begin -= 1
        found.append((at, begin, AFTER.match(text, at + 1).end()))
        free, at = at + 1, text.find("@", at + 1)
    return found


def decoded_starts(text: str) -> np.ndarray:
    """Starts of the windows with a digit or @, and of all whose middle half, or edge of the text, lies in the run of an @."""
    parts = [window_starts(text)]
    for _, a, b in address_runs(text):
        parts.append(np.arange((a - STRIDE // 2) // STRIDE, (b - 1 - STRIDE // 2) // STRIDE + 1).clip(0) * STRIDE)
    return np.unique(np.concatenate(parts))


def windows(text: str, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate([codes(text), np.full(WINDOW, PAD)])
    return padded[starts[:, None] + np.arange(WINDOW)[None]]


def span_tags(spans: list[Span], length: int) -> np.ndarray:
    tags = np.zeros(length, np.int8)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        if not tags[a:b].any():
            tags[a], tags[a + 1 : b] = 2 * k + 1, 2 * k + 2
    return tags


def tag_spans(tags: np.ndarray) -> list[Span]:
    """Runs of one kind; a continuation that nothing begins also begins a run."""
    found, begin, kind = [], 0, -1
    for at in [*np.flatnonzero(tags).tolist(), len(tags)]:
        tag = int(tags[at]) if at < len(tags) else 0
        k = (tag - 1) // 2 if tag else -1
        if kind >= 0 and (k != kind or tag % 2 or at != end):
            found.append((KINDS[kind], begin, end))
            kind = -1
        if tag and kind < 0:
            begin, kind = at, k
        end = at + 1
    return found


def sensible(kind: str, text: str) -> bool:
    """The checks of the patterns, on text with other separators."""
    if kind == "email":
        local, _, domain = text.replace(" ", "").partition("@")
        return bool(local) and all(c in LOCAL for c in local) and DOMAIN.fullmatch(domain) is not None
    if kind == "ip":
        parts = re.split(r"[^0-9]+", text)
        return len(parts) == 4 and all(parts) and valid_address(parts)
    if kind == "card":
        return valid_card(text)
    return valid_phone(text) and ("(" in text or "+" in text or len(re.findall(r"[\x20./-]", text)) >= 2)


def added_spans(texts: list[str], base: list[list[Span]], tagger: Tagger) -> list[list[Span]]:
    """The tagger's spans of each text that pass the checks and lie beside the given ones."""
    starts = [decoded_starts(t) for t in texts]
    tags = [np.zeros(len(t), np.int8) if len(s) else None for t, s in zip(texts, starts, strict=True)]
    jobs = [(n, s) for n, ss in enumerate(starts) for s in ss.tolist()]
    inputs = [windows(t, s) for t, s in zip(texts, starts, strict=True) if len(s)]
    given = np.concatenate(inputs) if inputs else np.empty((0, WINDOW), np.int64)
    for at in range(0, len(jobs), TOGETHER):
        for (n, s), got in zip(jobs[at : at + TOGETHER], tagger.decode(given[at : at + TOGETHER]), strict=True):
            a, b = (0 if s == 0 else STRIDE // 2), STRIDE // 2 + STRIDE
            part = tags[n][s + a : s + b]
            part[:] = got[a : a + len(part)]
    read_around_marks(texts, tags, tagger)
    out = []
    for n, text in enumerate(texts):
        found = []
        if tags[n] is not None:
            taken = span_tags(base[n], len(text)) > 0
            for kind, a, b in tag_spans(tags[n]):
                while b > a and text[b - 1] in " .,;:-(/":
                    b -= 1
                while a < b and text[a] in " .,;:-)/":
                    a += 1
                # part of a longer number or word is not a span
                whole = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
                if b > a and whole and not taken[a:b].any() and sensible(kind, text[a:b]):
                    found.append((kind, a, b))
        out.append(found)
    return out


def read_around_marks(texts: list[str], tags: list[np.ndarray | None], tagger: Tagger) -> None:
    """Puts the e-mail that each @ has in its own window into the tags."""
    jobs = [(n, at, max(0, at - ASIDE)) for n, t in enumerate(texts) if "@" in t for at in (m.start() for m in re.finditer("@", t))]
    for k in range(0, len(jobs), TOGETHER):
        some = jobs[k : k + TOGETHER]
        given = np.full((len(some), 2 * ASIDE), PAD)
        for row, (n, _, s) in enumerate(some):
            own = codes(texts[n][s : s + 2 * ASIDE])
            given[row, : len(own)] = own
        for (n, at, s), got in zip(some, tagger.decode(given), strict=True):
            for kind, a, b in tag_spans(got[: len(texts[n]) - s]):
                if kind == "email" and a <= at - s < b:
                    line = tags[n]
                    line[s + a], line[s + a + 1 : s + b] = 1, 2
                    after = s + b
                    while after < len(line) and line[after] == 2:
                        line[after] = 0
                        after += 1


def written_examples(count: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows of made-up words around spans in ordinary and further spellings, and numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    number = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    word = lambda: "".join(pick(["an", "re", "ti", "on", "the", "do", "ue", "ch", "ö", "é", "ver", "s"]) for _ in range(int(rng.integers(1, 4))))

    def span() -> tuple[str, str | None]:
        kind = pick([*KINDS, *KINDS, None])
        if kind == "email":
            at, dot = pick(["@", "@", " @ ", "@ "]), pick([".", ".", " . "])
            return word() + pick([".", "_", ""]) + pick([number(2), word()]) + at + word() + pick([number(1), ""]) + dot + pick(["com", "org", "net", "de"]), kind
        if kind == "ip":
            return pick([".", ".", " . ", "-", ","]).join(str(x) for x in rng.integers(0, 256, 4)), kind
        if kind == "card":
            return pick([" ", "-", "", ".", "/"]).join([number(4), number(4), number(4), number(pick([4, 4, 3]))]), kind
        if kind == "phone":
            front = pick(["+" + number(pick([1, 2])) + " ", "+" + number(2) + ".", ""])
            return front + pick(["(" + number(3) + ") ", number(3) + pick(["-", " ", "."])]) + number(3) + pick(["-", " ", "."]) + number(4), kind
        return pick([number(4), number(2) + "." + number(1), number(9), number(6), number(1), number(4) + "-" + number(2) + "-" + number(2), "@" + word(), word() + "@"]), None

    xs, ys = np.full((count, WINDOW), PAD), np.zeros((count, WINDOW), np.int64)
    for row in range(count):
        text, spans = " ".join(word() for _ in range(int(rng.integers(0, 8)))) + " ", []
        while len(text) < WINDOW + 30:
            made, kind = span()
            if kind:
                spans.append((kind, len(text), len(text) + len(made)))
            text += made + pick([" ", ", ", ". ", "\n"]) + " ".join(word() for _ in range(int(rng.integers(1, 6)))) + " "
        skip = int(rng.integers(0, 30))
        xs[row], ys[row] = codes(text)[skip : skip + WINDOW], span_tags(spans, len(text))[skip : skip + WINDOW]
        if ys[row][0] and ys[row][0] % 2 == 0:
            ys[row][0] -= 1  # a window that begins inside a span begins it
    return xs, ys


def train(docs: DataFrame, rows: int = TRAIN_DOCUMENTS, limit: int = TRAIN_WINDOWS, steps: int = STEPS) -> Tagger:
    """A tagger from the patterns' spans in a bounded sample of the documents and from written examples."""

    def labelled(batch: pa.RecordBatch) -> pa.RecordBatch:
        xs, ys = [], []
        for text in texts_of(batch):
            starts = window_starts(text)
            if len(starts):
                tags = np.concatenate([span_tags(base_spans(text), len(text)), np.zeros(WINDOW, np.int8)])
                xs += [x.astype(np.int8).tobytes() for x in windows(text, starts)]
                ys += [y.tobytes() for y in tags[starts[:, None] + np.arange(WINDOW)[None]]]
        return pa.record_batch([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], ["x", "y"])

    ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = per_block(docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text"), labelled, "x binary, y binary")
    got = found.distinct().orderBy(F.xxhash64("x"), "x", "y").limit(limit).toPandas()
    x, y = written_examples(WRITTEN_WINDOWS)
    if len(got):
        own_x = np.frombuffer(b"".join(got["x"]), np.int8).reshape(-1, WINDOW).astype(np.int64)
        own_y = np.frombuffer(b"".join(got["y"]), np.int8).reshape(-1, WINDOW).astype(np.int64)
        first = own_y[:, 0]
        own_y[:, 0] = np.where((first > 0) & (first % 2 == 0), first - 1, first)
        x, y = np.concatenate([x, own_x]), np.concatenate([y, own_y])
    tagger = Tagger.new()
    tagger.train(x, y, steps)
    return tagger


def listed(spans: list[Span]) -> str:
    ranked = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in ranked)


def personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added per row.

    The counts and base_sha256 are of the patterns alone, spans has the added ones too.  Null texts are empty, and have no span;
    rows repeat as they come; a null doc_id stays null.  No rows give no rows.
    """
    tagger = tagger or train(docs)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        base = [base_spans(t) for t in texts]
        added = added_spans(texts, base, tagger)
        counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in KINDS]
        sums = [hashlib.sha256(listed(b).encode()).hexdigest() for b in base]
        spans = [listed(b + a) for b, a in zip(base, added, strict=True)]
        names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
        return pa.record_batch([batch.column("doc_id"), *counts, pa.array(sums), pa.array(spans), pa.array([len(a) for a in added], pa.int64())], names)

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fields = "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string, n_added long"
    return per_block(taken, of, fields)
