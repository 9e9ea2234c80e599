"""Personal data: rules for exact forms, and a character-level BiLSTM-CRF for what the rules miss.

The rules find e-mail addresses, IP addresses, card and phone numbers in whole texts. The net is trained in numpy, once
in a driver for each set of labelled spans: at most ``LABELLED`` short passages of each kind that the rules find in the
documents, drawn by hash from those whose crc32(doc_id) mod 5 isn't 0, and invented texts: some show usual and unusual
forms (``name (at) host``, ``name @ host . org``, numbers without the country's plus, cards next to other digits, defanged
addresses) among numbers that are none; in others what stands around a number decides, as it may be a phone's after *tel* and
an order's after *ref*, in one and the same shape. It sees letters, so it can tell. It reads windows of ``WINDOW`` characters that overlap by ``OVERLAP``; every
window that can hold a span is read, and one can't unless a digit, an @ or a bracketed *at* is near (each accepted form
has one), so most text costs only a search for these. Windows are decoded by themselves. A span cut off by a window's edge
that no other window holds whole is read again in a window centred on it and twice as wide, and so on until it is whole.
All spans are then reconciled over the text: equal ones add up, and of overlapping ones the set of greatest total
confidence stays. What is left is checked exactly (parts up to 255, Luhn's sum, 10 to 15 digits for phones, whose grouping is
free) and added where it meets no rule's span.

One narrow pass; the net (some 10 kB) goes with the tasks. Null texts are empty and have no spans; their digest is that
of the empty string. Repeated rows are searched each for itself. Very long texts are searched whole, some four bytes a
character at a time. An empty table gives no rows. Other columns are ignored by ``find`` and passed through by ``redact``.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bilstm_crf import Net, allowed, fit, tags_of
from .common import decoded, map_rows, text_bytes

KINDS = ("email", "ip", "card", "phone")
TAGS = tags_of(KINDS)
WINDOW, OVERLAP = 96, 48
NEAR = 48
GROUP = 1024
#: Labelled passages of each kind that training takes from documents, documents that are looked through for them on
#: average, and the characters kept around a span.
LABELLED = 150
LOOKED_AT = 20_000
AROUND = 16
#: Characters of texts that wait for their windows.
HELD_CHARS = 4_000_000
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does, so the look-behind changes nothing but the time
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NEEDED = re.compile(r"[0-9@]|[(\[]\s*at\s*[)\]]|\sat\s+[a-z0-9-]+\s+dot\s", re.I)

Span = tuple[int, int, str]


def digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(number: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(number)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def parts_fit(address: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in address.split("."))


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ outward: a match's
    first part is the whole run before its @, back to the end of the match before."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The rules' spans, in order."""
    out: list[Span] = []
    if "@" in text:
        out += emails(text)
    if re.search("[0-9]", text):
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if parts_fit(m[0])]
        out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=in_order)


def in_order(span: Span) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def plausible(text: str, kind: str) -> bool:
    """The exact check of a span that the net adds."""
    if kind == "email":
        plain = re.sub(r"\s*(?:@|[(\[]\s*at\s*[)\]])\s*|\s+at\s+", "@", text, flags=re.I)
        plain = re.sub(r"\s*[(\[]\s*dot\s*[)\]]\s*|\s+\.\s+|\s+dot\s+", ".", plain, flags=re.I)
        return re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", plain) is not None
    if kind == "ip":
        plain = text.replace("[.]", ".")
        return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", plain) is not None and parts_fit(plain)
    if kind == "card":
        return re.fullmatch(r"[0-9]([\x20-]?[0-9])+", text) is not None and 14 <= len(d := digits(text)) <= 19 and luhn(d)
    # a phone number without plus: whether its 10 to 15 digits are one is the net's to say
    return re.fullmatch(r"\(?[0-9][0-9() ./-]*[0-9]", text) is not None and text.count("(") == text.count(")") and 10 <= len(digits(text)) <= 15


# --- what the net reads ---

SYMBOLS = "@.-+()[]_%:/ \n,"


@functools.lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbols: 0 padding, 1 digit, 2 a letter beyond a to z, 3 all else, then a to z (in either case) and single marks."""
    table = np.full(0x10001, 3, dtype=np.uint8)
    for c in range(0x250):
        if chr(c).isalpha():
            table[c] = 2
    table[48:58] = 1
    for i, ch in enumerate(LETTERS + SYMBOLS):
        table[ord(ch)] = table[ord(ch.upper())] = 4 + i
    return table


LETTERS = "abcdefghijklmnopqrstuvwxyz"
N_SYMBOLS = 4 + len(LETTERS) + len(SYMBOLS)


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return symbol_table()[np.minimum(points, 0x10000)]


def windows(text: str) -> list[int]:
    """Starts of the windows that can hold a span."""
    stride = WINDOW - OVERLAP
    out: list[int] = []
    covered = -1
    for m in NEEDED.finditer(text):
        if m.end() + NEAR <= covered:
            continue
        # windows lie on a fixed grid, so the same text is always cut alike
        first = max(0, (m.start() - NEAR) // stride - 1)
        last = (m.end() + NEAR) // stride
        out += [w * stride for w in range(max(first, out[-1] // stride + 1 if out else 0), last + 1) if w * stride < len(text)]
        covered = last * stride
    return out


def invented(count: int = 2400, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Texts with labelled spans: each has words, numbers that are none, and mostly one span."""
    rng = random.Random(seed)
    syllables = "an er th on in re ti es or te ou le de la que ver ung sch cion ado ment eau st ha nd".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def words(n: int) -> str:
        return " ".join((w.capitalize() if rng.random() < 0.15 else w) + rng.choice(["", "", "", "", ".", ","]) for w in (word() for _ in range(n)))

    def host() -> str:
        return rng.choice([f"mail{num(1)}.", "www.", "", f"{word()}.", f"{word()}-"]) + word() + rng.choice([".com", ".org", ".net", ".de", ".example.com"])

    def email() -> str:
        who = rng.choice([word(), f"{word()}.{word()}", f"{word()}{num(2)}", f"{word()}.{num(2)}", f"{word()}_{word()}"])
        return who + rng.choice(["@", "@", "@", " @ ", " (at) ", "(at)", " [at] ", "[at]"]) + (host() if rng.random() < 0.85 else host().replace(".", rng.choice([" . ", " (dot) ", "[dot]"])))

    def ip() -> str:
        return rng.choice([".", ".", ".", "[.]"]).join(str(rng.randint(0, 255)) for _ in range(4))

    def card() -> str:
        body = num(rng.choice([13, 15, 15, 15, 15]))
        body += next(d for d in "0123456789" if luhn(body + d))
        gap = rng.choice(["", "", " ", "-"])
        return gap.join(body[i : i + 4] for i in range(0, len(body), 4))

    def phone() -> str:
        area = num(3)
        local = rng.choice(["-", " ", "."]).join([num(3), num(4)])
        return rng.choice([f"+{num(1)} ({area}) {local}", f"+{num(2)} {area} {local}", f"({area}) {local}", f"{area}-{num(3)}-{num(4)}", f"{area}.{num(3)}.{num(4)}", f"{area} {num(3)} {num(4)}", f"0{num(3)} {num(rng.randint(6, 8))}", f"00{num(2)} {num(2)} {num(7)}", f"0{num(1)} " + " ".join(num(2) for _ in range(4)), f"0{num(2)}/{num(7)}", f"(0{num(3)}) {num(3)} {num(4)}"])

    def other() -> str:
        return rng.choice([num(rng.randint(1, 9)), num(rng.randint(10, 13)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"{num(4)}-{num(2)}-{num(2)} {num(2)}:{num(2)}:{num(2)}", f"{num(3)} {num(2)} {num(1)}", f"{num(1)}.{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{num(3)},{num(3)}", f"@{word()}", f"{word()}@{word()}", f"{num(2)}.{num(2)}.{num(4)}", f"({word()})", f"{word()} at {word()}", f"{num(4)}-{num(4)}"])

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(count):
        text, spans = words(rng.randint(0, 5)), []
        for _ in range(rng.randint(1, 2)):
            text += rng.choice([" ", " ", "\n", ""]) if text and text[-1] in ".," else " " if text else ""
            if rng.random() < 0.25:
                text += other() + " " + words(rng.randint(0, 2))
                text += " " if text[-1] != " " else ""
            kind = rng.choice(KINDS)
            piece = make[kind]()
            if kind == "card" and rng.random() < 0.25:  # other digits right before it
                text += num(rng.randint(1, 4)) + " "
            spans.append((len(text), len(text) + len(piece), kind))
            text += piece + rng.choice([" ", " ", ". ", ", ", "\n"]) + words(rng.randint(0, 4))
        if rng.random() < 0.2:
            text, spans = words(4) + " " + other() + " " + words(3) + " " + other() + " " + words(2), []
        out.append((text, spans))
    return out


#: What stands before a number that is a phone's, and before numbers of the same shapes that are something else.
CALLS = "tel phone telephone call mobile cell fax telefon téléphone teléfono telefono ring whatsapp sms hotline handy móvil portable anruf llamar appelez".split()
OTHERS = "order invoice ref account serial isbn tracking ticket case batch customer contract part item id code article rechnung bestellung konto facture commande pedido cuenta factura timestamp record".split()


def ambiguous(count: int = 2000, seed: int = 23) -> list[tuple[str, list[Span]]]:
    """Texts in which what stands around a number of 10 to 15 digits, and not its shape, says whether it's a phone number; and
    addresses in words beside other uses of *at* and *dot*."""
    rng = random.Random(seed)
    syllables = "an er th on in re ti es or te ou le de la que ver ung sch cion ado ment eau st ha nd".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    words = lambda n: "".join(word() + rng.choice([" ", " ", " ", ", ", ". "]) for _ in range(n))

    def number() -> str:
        gap = rng.choice(["", "", " ", "-", ".", "/"])
        sizes = rng.choice([[3, 3, 4], [2, 4, 4], [4, 7], [3, 8], [4, 3, 3, 3], [5, 6], [2, 2, 2, 2, 2], [4, 4, 4], [4, 2, 2, 2, 2]]) if gap else [rng.randint(10, 15)]
        return gap.join(num(n) for n in sizes)

    out = []
    for _ in range(count):
        text, spans = words(rng.randint(0, 5)), []
        kind = rng.random()
        if kind < 0.8:
            called = kind < 0.35
            cue = rng.choice(CALLS if called else OTHERS) if kind < 0.7 else word()
            cue = rng.choice([cue, cue, cue.capitalize(), cue.upper()])
            text += cue + rng.choice([": ", ": ", " ", " ", ". ", " no. ", " nr ", " = ", "\n", f" {word()} ", ":"])
            piece = number()
            if called:
                spans.append((len(text), len(text) + len(piece), "phone"))
            text += piece
        elif kind < 0.9:
            who, host = rng.choice([word(), f"{word()}.{word()}", f"{word()}{num(2)}"]), word()
            piece = f"{who} at {host} dot {rng.choice(['com', 'org', 'net', 'de'])}"
            spans.append((len(text), len(text) + len(piece), "email"))
            text += piece
        else:
            text += rng.choice([f"{word()} at {word()} dot. {word()}", f"at {num(2)}:{num(2)} {word()}", f"{word()} at {word()}", f"the dot at {word()}"])
        text += rng.choice([" ", ". ", ", ", "\n"]) + words(rng.randint(0, 5))
        out.append((text, spans))
    return out


def training_rows(labelled: list[tuple[str, list[Span]]], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows of symbols and tags; a text longer than a window gives one that begins anywhere outside its spans."""
    rng = random.Random(seed)
    x = np.zeros((len(labelled), WINDOW), dtype=np.uint8)
    y = np.zeros((len(labelled), WINDOW), dtype=np.int64)
    for r, (text, spans) in enumerate(labelled):
        tags = np.zeros(len(text), dtype=np.int64)
        for start, end, kind in spans:
            tags[start:end] = TAGS.index(f"I-{kind}")
            tags[start] -= 1
        begin = rng.randint(0, max(0, len(text) - WINDOW))
        while begin and TAGS[tags[begin]][0] == "I":
            begin -= 1
        n = min(WINDOW, len(text) - begin)
        x[r, :n] = symbols(text)[begin : begin + n]
        y[r, :n] = tags[begin : begin + n]
    return x, y


_NETS: dict[tuple, Net] = {}


def train(labelled: list[tuple[str, list[Span]]]) -> Net:
    """A net from texts with labelled spans; the same texts give the same net, which is kept."""
    key = tuple((text, tuple(spans)) for text, spans in labelled)
    if key not in _NETS:
        if len(_NETS) >= 4:
            _NETS.clear()
        _NETS[key] = fit(*training_rows(labelled), N_SYMBOLS, TAGS)
    return _NETS[key]


def default_net() -> Net:
    return train(invented() + ambiguous())


def net_for(docs: DataFrame) -> Net:
    """A net trained on labelled passages of documents and on invented ones."""
    return train(labelled(docs) + invented() + ambiguous())


def _passages(rows: Iterator[tuple]) -> Iterator[tuple]:
    for place, raw in rows:
        text = decoded(raw)
        spans = base_spans(text)
        for start, end, kind in spans:
            first, last = max(0, start - AROUND), min(len(text), end + AROUND)
            inside = [s for s in spans if first < s[1] and s[0] < last]
            if last - first <= WINDOW and inside == [(start, end, kind)] and not NEEDED.search(text[first:start] + " " + text[end:last]):
                yield place, kind, text[first:last].encode("utf-8", "replace").decode(), start - first, end - first


def labelled(docs: DataFrame, each: int = LABELLED) -> list[tuple[str, list[Span]]]:
    """At most ``each`` passages of each kind with the span that a rule finds in them and nothing near it that might be
    another, from documents whose crc32(doc_id) mod 5 isn't 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_bytes().alias("text"))
    place = F.xxhash64("id", "text", F.lit(5))
    share = min(1.0, LOOKED_AT / max(1, rows.count()))
    part = F.pmod(place, F.lit(1 << 30)) / F.lit(float(1 << 30))
    fitted = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) != 0, F.lit(True))
    told = map_rows(rows.filter(fitted & (part < share)), [place, F.col("text")], _passages, "place long, kind string, text string, start int, stop int")
    first = Window.partitionBy("kind").orderBy("place", "start", "text")
    some = told.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= each).collect()
    return [(r.text, [(r.start, r.stop, r.kind)]) for r in sorted(some)]


def window_spans(net: Net, x: np.ndarray) -> list[list[tuple[int, int, str, float]]]:
    """Of each window its decoded spans, with the margin by which their tags lead, added up."""
    emissions, _ = net.run(x)
    tags = net.decode(emissions, allowed(TAGS))
    width = x.shape[1]
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in range(len(x))]
    for r in np.nonzero(tags.any(axis=1))[0].tolist():
        row = tags[r].tolist()
        t = 0
        while t < width:
            if not row[t]:
                t += 1
                continue
            end = t + 1
            inside = row[t] + 1 if row[t] % 2 else row[t]
            while end < width and row[end] == inside:
                end += 1
            lead = emissions[r, np.arange(t, end), row[t:end]] - emissions[r, t:end, 0]
            out[r].append((t, end, TAGS[row[t]][2:], float(lead.sum())))
            t = end
    return out


def read_again(net: Net, text: str, found: list[tuple[int, int, str, float]], cut: list[tuple[int, int]]) -> None:
    """Add to ``found`` the spans of which windows saw only the pieces ``cut``. Wider windows that meet are read as one,
    so a round reads each character once, and each round is twice as wide."""
    codes = symbols(text)
    cut = [(a, b) for a, b in cut if not any(s <= a and b <= e for s, e, _, _ in found)]
    margin = WINDOW // 2
    while cut:
        margin *= 2
        merged: list[list[int]] = []
        for a, b in sorted(cut):
            start, end = max(0, a - margin), min(len(text), b + margin)
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        pieces, cut = cut, []
        for start, end in merged:
            for a, b, kind, score in window_spans(net, codes[None, start:end])[0]:
                a, b = start + a, start + b
                if not any(a < d and c < b for c, d in pieces):
                    continue  # the first windows have seen it
                if (a == start and start > 0) or (b == end and end < len(text)):
                    cut.append((a, b))
                else:
                    found.append((a, b, kind, score))


def reconcile(spans: list[tuple[int, int, str, float]]) -> list[Span]:
    """Of spans from overlapping windows the non-overlapping ones of greatest total confidence."""
    total: dict[Span, float] = {}
    for start, end, kind, score in spans:
        if score > 0:
            total[start, end, kind] = total.get((start, end, kind), 0.0) + score
    items = sorted(total.items(), key=lambda x: (x[0][1], x[0][0], x[0][2]))
    ends = np.array([s[1] for s, _ in items])
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
    for i, ((start, _, _), score) in enumerate(items):
        before = int(np.searchsorted(ends[:i], start, side="right"))
        took = best[before][0] + score
        best.append((took, before, True) if took > best[i][0] else (best[i][0], i, False))
    out, i = [], len(items)
    while i:
        _, before, took = best[i]
        if took:
            out.append(items[i - 1][0])
        i = before
    return out[::-1]


def added(text: str, found: list[tuple[int, int, str, float]], base: list[Span]) -> list[Span]:
    """The net's spans that pass their check and meet no rule's span. An address takes in the whole run that its first part
    lies in, as a rule's does."""
    out = []
    taken = sorted(base)
    ends = np.maximum.accumulate(np.array([e for _, e, _ in taken], dtype=np.int64)) if taken else np.zeros(0, np.int64)
    starts = np.array([s for s, _, _ in taken], dtype=np.int64)
    last = 0
    for start, end, kind in reconcile(found):
        while kind == "email" and start > last and text[start - 1] in LOCAL:
            start -= 1
        last = end
        before = int(np.searchsorted(starts, end, side="left"))
        if before and ends[before - 1] > start:
            continue
        if plausible(text[start:end], kind) and not (text[start - 1 : start].isdigit() or text[end : end + 1].isdigit()):
            out.append((start, end, kind))
    return out


def _search(net: Net, rows: Iterator[tuple]) -> Iterator[tuple[tuple, str, list[Span], list[Span]]]:
    """Each row with its text, the rules' spans and the net's. Windows of many rows go through the net at once."""
    waiting: list[tuple[tuple, str, list[Span], list[tuple[int, int, str, float]]]] = []
    cut: dict[int, list[tuple[int, int]]] = {}
    places: list[tuple[int, int]] = []
    held: list[np.ndarray] = []
    chars = 0

    def read() -> None:
        if held:
            for (k, start), spans in zip(places, window_spans(net, np.stack(held)), strict=True):
                text = waiting[k][1]
                last = len(text) - start
                for a, b, kind, s in spans:
                    if (a > 0 or start == 0) and (b < WINDOW or last <= WINDOW):
                        waiting[k][3].append((start + a, start + b, kind, s))
                    else:  # mostly seen whole in another window
                        cut.setdefault(k, []).append((start + a, start + min(b, last)))
        held.clear()
        places.clear()

    def settle() -> Iterator[tuple[tuple, str, list[Span], list[Span]]]:
        read()
        for k, pieces in cut.items():
            read_again(net, waiting[k][1], waiting[k][3], pieces)
        cut.clear()
        yield from ((r, t, b, added(t, f, b)) for r, t, b, f in waiting)
        waiting.clear()

    for *rest, raw in rows:
        text = decoded(raw)
        waiting.append((tuple(rest), text, base_spans(text), []))
        if starts := windows(text):
            codes = symbols(text)
            for start in starts:
                x = np.zeros(WINDOW, dtype=np.uint8)
                part = codes[start : start + WINDOW]
                x[: len(part)] = part
                held.append(x)
                places.append((len(waiting) - 1, start))
                if len(held) >= GROUP:
                    read()
        chars += len(text)
        if chars >= HELD_CHARS or len(waiting) >= (2048 if held else 256):
            yield from settle()
            chars = 0
    yield from settle()


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=in_order))


def _find(net: Net, rows: Iterator[tuple]) -> Iterator[tuple]:
    for (doc_id,), _, base, more in _search(net, rows):
        counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
        yield doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)


def find(docs: DataFrame, net: Net | None = None) -> DataFrame:
    """Per document: counts of the rules' spans, the digest of their list, and the list of all spans."""
    return map_rows(docs, [F.col("doc_id").cast("long"), text_bytes()], functools.partial(_find, net or net_for(docs)), SCHEMA)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span (of overlapping ones their union, under the first one's kind) replaced by its kind."""
    out, end = [], 0
    for start, stop, kind in sorted(spans, key=in_order):
        if start >= end:
            out += [text[end:start], f"[{kind.upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def _redact(net: Net, at: int, width: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    for rest, text, base, more in _search(net, (((*r, r[at])) for r in rows)):
        row = list(rest)
        if row[at] is not None:
            row[at] = mask(text, base + more)
            if width >= 0:
                row[width] = len(row[at])
        yield tuple(row)


def redact(docs: DataFrame, net: Net | None = None) -> DataFrame:
    """The documents with every span masked, and ``n_chars`` set anew where a text has changed; a null text stays null."""
    names = docs.columns
    at, width = names.index("text"), names.index("n_chars") if "n_chars" in names else -1
    columns = [text_bytes() if c == "text" else F.col(f"`{c}`") for c in names]
    schema = ", ".join(f"`{c}` {'string' if c == 'text' else kind}" for c, kind in docs.dtypes)
    return map_rows(docs, columns, functools.partial(_redact, net or net_for(docs), at, width), schema)
