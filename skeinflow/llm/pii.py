"""Personal data: base patterns, and a semi-Markov conditional random field over candidate spans.

The field scores whole spans: a candidate (a run of tokens and a kind) has features of its text, its edges and what
stands before it, and the weight of a segmentation is the sum over its spans; what lies between spans weighs nothing.
Dynamic programming over token ends, with entities of at most MOST_TOKENS tokens, takes the best set of spans that don't
overlap, boundaries and kinds at once. The weights maximise the conditional likelihood (forward and backward sums over
all segmentations) of a seeded set of written examples; they are fitted once, when a query is built.

Only stretches around tokens with a digit or an @ can hold an entity, so all other text is skipped. The base patterns'
spans always stay; the field's spans are added where they overlap none of them: secrets (of one token or of several that
stand together, so their prefix belongs to them), phones without a plus, social security numbers and bank accounts.

Null and empty texts have no spans, an empty table gives no rows; work grows with the text's length. Offsets are code points of the whole text, ends exclusive. Repeated rows give
repeated results.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import map_texts, table

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
MOST_TOKENS = 24
#: Tokens to either side of one with a digit or @ that belong to its stretch.
AROUND = 6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can only start where a run of digits does
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\W_]+|_+|[^\w\s]")
_TRIGGER = re.compile(r"[^\W_]*[0-9][^\W_]*|@")
_KEYWORD = re.compile(r"(?i)^(?:token|secret|password|passwd|pwd|apikey|api|key|bearer|auth|credential|access|private|jwt)s?$")
#: How keys of well-known kinds start.
_PREFIX = re.compile(r"(?:gh[opsur]_|github_pat_|glpat-|sk[-_]|[spr]k_live_|xox[abp]-|AKIA|ASIA|AIza|hf_|npm_|eyJ)")
_IBAN_START = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]*$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost spans that don't overlap, by kind; what fails its check is dropped and not tried again."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS[:4]}
    if not _HINT.search(text):
        return found
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found["email"].append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found["card"].append(m.span())
    found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


def stretches(text: str):
    """Lists of (start, end) of tokens that lie near a token with a digit or @."""
    if not _HINT.search(text):
        return
    near: list[tuple[int, int]] = []  # stretches of characters to look at
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - 60), min(len(text), m.end() + 60)
        if near and a <= near[-1][1]:
            near[-1] = (near[-1][0], b)
        else:
            near.append((a, b))
    for a, b in near:
        # a stretch never starts or ends within a token
        while a > 0 and text[a].isalnum() and text[a - 1].isalnum():
            a -= 1
        while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
            b += 1
        tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
        marked = [i for i, (s, e) in enumerate(tokens) if _TRIGGER.match(text, s, e)]
        part: list[int] = []
        for i in marked:
            if part and i - part[-1] > 2 * AROUND:
                yield tokens[max(0, part[0] - AROUND) : part[-1] + AROUND + 1]
                part = []
            part.append(i)
        if part:
            yield tokens[max(0, part[0] - AROUND) : part[-1] + AROUND + 1]


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in (s.count(c) for c in set(s)))


def _mod97(s: str) -> bool:
    """The check of bank account numbers: four characters moved to the end, letters as numbers."""
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of the whole span of tokens i to j (exclusive)."""
    start, end = tokens[i][0], tokens[j - 1][1]
    s = text[start:end]
    out = []
    digits = _digits(s)
    if digits:
        n = len(digits)
        out.append("digits:" + ("1-6" if n < 7 else "7-8" if n < 9 else "9-12" if n < 13 else "13-15" if n < 16 else "16-19" if n < 20 else "20+"))
        if 13 <= n <= 19 and not re.search(r"[^0-9 -]", s):
            out.append("luhn" if luhn(digits) else "not-luhn")
    shape = re.sub(r"[0-9]+", "9", s)
    if shape == "9.9.9.9":
        out.append("quad-in-range" if all(int(p) <= 255 for p in s.split(".")) else "quad-out-of-range")
    if s[0] == "+":
        out.append("plus")
    if re.fullmatch(r"\+?[0-9() .-]+", s):
        out.append("dialled")
        groups = re.findall(r"[0-9]+", s)
        if len(groups) <= 5:
            out.append("groups:" + "-".join(str(len(g)) for g in groups))
        if len(set(re.findall(r"[^0-9]", s))) == 1:
            out.append("parted:" + re.search(r"[^0-9]", s).group())
        if [len(g) for g in groups] == [3, 2, 4]:
            out.append("no-area" if groups[0] in ("000", "666") or groups[0] > "899" or groups[1] == "00" or groups[2] == "0000" else "area")
        if re.search(r"\([0-9]{2,4}\)", s):
            out.append("area-code")
        if re.search(r"[0-9]{3}[-. ][0-9]{4}$", s):
            out.append("subscriber")
    at = s.count("@")
    if at:
        name, _, host = s.partition("@")
        out.append("one-at" if at == 1 else "many-at")
        out.append("host" if re.fullmatch(r"[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}", host) else "no-host")
        out.append("name" if re.fullmatch(r"[\w.%+-]+", name) else "no-name")
    if re.search(r"\s", s):
        out.append("space")
    if j - i == 1:
        out.append("single")
    if digits and not at and len(s) >= 16 and not re.search(r"\s", s) and re.search("[A-Za-z]", s):
        parts = re.split(r"[-_.]+", s)
        longest = max(parts, key=len)
        mixed = any(map(str.isdigit, longest)) and any(map(str.isalpha, longest))
        if len(longest) >= 16 and mixed:
            out.append("long-mixed")
            out.append("high-entropy" if _entropy(longest) > 3 else "low-entropy")
            if re.fullmatch(r"[0-9a-fA-F]{32,}", longest):
                out.append("hex")
        elif all(p.isalpha() or p.isdigit() for p in parts):
            out.append("words-and-numbers")
        if re.search("[a-z]", longest) and re.search("[A-Z]", longest) and mixed:
            out.append("three-classes")
        if _PREFIX.match(s):
            out.append("known-prefix")
        if len(parts) > 1:
            out.append(f"parts:{min(len(parts), 5)}")
    if _IBAN_START.match(text[tokens[i][0] : tokens[i][1]]) and re.fullmatch(r"[A-Z0-9 ]+", s):
        n = len(s.replace(" ", ""))
        out.append("account" if 15 <= n <= 34 and _mod97(s) else "no-account")
    before = [text[a:b] for a, b in tokens[max(0, i - 4) : i]]
    if any(map(_KEYWORD.match, before)):
        out.append("after-keyword")
    if before and before[-1] in "=:\"'":
        out.append("assigned")
    glued = lambda c: c.isalnum() or c in "_@%+-"
    if start and (glued(text[start - 1]) or text[start - 1] == "." and i and tokens[i - 1][1] == start and start > 1 and text[start - 2].isalnum()):
        out.append("glued-left")
    if end < len(text) and (glued(text[end]) or text[end] == "." and end + 1 < len(text) and text[end + 1].isalnum()):
        out.append("glued-right")
    return out


#: Groups of digits that a number is written in at most.
MOST_GROUPS = 6


def candidates(text: str, tokens: list[tuple[int, int]]):
    """Spans that may be entities: by the look of their edges, with at least one feature that tells."""
    n = len(tokens)
    for i in range(n):
        first = text[tokens[i][0] : tokens[i][1]]
        if not (first[0].isalnum() or first in "+(_%"):
            continue
        n_digits = dots = groups = 0
        held_at = letters = False
        account, joined = bool(_IBAN_START.match(first)), True
        opens = not tokens[i][0] or not (text[tokens[i][0] - 1].isalnum() or text[tokens[i][0] - 1] in "-_.")
        for j in range(i + 1, min(n, i + MOST_TOKENS) + 1):
            s, e = tokens[j - 1]
            spaced = j - i > 1 and s > tokens[j - 2][1]
            if spaced and s - tokens[j - 2][1] > 1:  # at most one space within a span
                break
            c = text[s:e]
            joined &= not spaced and (c[0].isalnum() or c[0] in "-_.")
            account &= c.isalnum() and c.upper() == c
            held_at |= c == "@"
            letters |= any(x.isalpha() for x in c)
            more = sum("0" <= x <= "9" for x in c)
            n_digits += more
            groups += more > 0
            dots += c == "."
            if spaced and (held_at or not n_digits and first not in "+("):
                break  # no spaces in what has an @ or no digits yet
            if j - i > 1 and not held_at and n_digits > 19 and not account and not joined:
                break  # too long for any number
            if groups > MOST_GROUPS and not (held_at or account or joined):
                break  # no number is written in so many groups
            if not c[-1].isalnum():
                continue
            if held_at or j - i == 1 and letters and n_digits and e - s >= 16:
                yield i, j
            elif joined and opens and letters and n_digits and e - tokens[i][0] >= 16 and not (e < len(text) and (text[e].isalnum() or text[e] == "_")):
                yield i, j
            elif account and 15 <= e - tokens[i][0] - (j - i - 1) <= 34:
                yield i, j
            elif not letters and (n_digits >= 7 or n_digits >= 4 and dots == 3):  # digits and signs only
                yield i, j


def scored(text: str, tokens: list[tuple[int, int]], weights: dict[tuple[str, str], float]):
    """(i, j, kind, features, score) of all candidates."""
    for i, j in candidates(text, tokens):
        f = ["bias", *features(text, tokens, i, j)]
        for kind in KINDS:
            yield i, j, kind, f, sum(weights.get((kind, x), 0.0) for x in f)


def best(text: str, tokens: list[tuple[int, int]], weights: dict[tuple[str, str], float]) -> list[tuple[str, int, int]]:
    """The best segmentation's spans: the highest sum, over what ends at each token."""
    n = len(tokens)
    ending: list[list[tuple[int, str, float]]] = [[] for _ in range(n + 1)]
    for i, j, kind, _, score in scored(text, tokens, weights):
        if score > 0:
            ending[j].append((i, kind, score))
    top, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        top[j] = top[j - 1]
        for i, kind, score in ending[j]:
            if top[i] + score > top[j]:
                top[j], back[j] = top[i] + score, (i, kind)
    out, j = [], n
    while j > 0:
        if back[j]:
            i, kind = back[j]
            out.append((kind, tokens[i][0], tokens[j - 1][1]))
            j = i
        else:
            j -= 1
    return out[::-1]


def examples(n: int = 400, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Written examples: (text, spans). Half of what looks like an entity isn't one."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvw") for _ in range(rng.randint(2, 8)))
    hexed = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def card(valid: bool) -> str:
        while True:
            x = d(rng.choice((15, 16, 16, 16)))
            if luhn(x) == valid:
                return x if rng.random() < 0.7 else "-".join(x[i : i + 4] for i in range(0, len(x), 4))

    mixed = lambda k: d(1) + rng.choice("ABCDEFGHJKLM") + rng.choice("abcdefghjk") + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(k - 3))

    def secret() -> str:
        which = rng.random()
        if which < 0.45:
            return hexed(rng.choice((32, 40, 40, 64))) if which < 0.35 else hexed(40).upper()
        if which < 0.8:
            return rng.choice(["ghp_", "gho_", "glpat-", "sk-", "sk-proj-", "sk_live_", "xoxb-", "AKIA", "hf_", "npm_"]) + mixed(rng.choice((20, 24, 36, 40)))
        return f"eyJ{mixed(20)}.eyJ{mixed(40)}.{mixed(30)}" if which < 0.9 else mixed(rng.choice((24, 32)))

    def account() -> str:
        country, rest = rng.choice(["DE", "FR", "GB", "ES", "NL"]), d(18)
        x = f"{country}{next(c for c in range(2, 99) if _mod97(f'{country}{c:02d}{rest}')):02d}{rest}"
        return x if rng.random() < 0.5 else " ".join(x[i : i + 4] for i in range(0, len(x), 4))

    quad = lambda most: ".".join(str(rng.randint(0, most)) for _ in range(4))
    made = {
        "email": lambda: f"{word()}{rng.choice(['', '.' + d(2), '.' + word(), '_' + word()])}@{word()}{rng.choice(['', d(1)])}.{rng.choice(['example.com', 'org', 'net', 'co.uk'])}",
        "ip": lambda: quad(255),
        "card": lambda: card(True),
        "phone": lambda: rng.choice([f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"+{rng.randint(1, 99)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{rng.randint(1, 9)}-{d(3)}-{d(3)}-{d(4)}"]),
        "secret": secret,
        "ssn": lambda: f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}",
        "iban": account,
    }
    no = [
        lambda: card(False), lambda: d(rng.randint(1, 6)), lambda: f"{d(1)}.{d(1)}", f"{rng.choice('123')}.0.".format, lambda: f"{rng.randint(256, 999)}.{quad(255)[:7]}", lambda: f"{d(4)}-{d(2)}-{d(2)}",
        lambda: f"{d(2)}:{d(2)}", lambda: f"@{word()}", lambda: f"{d(3)},{d(3)}", lambda: f"{word()}{d(2)}", lambda: f"{d(1)}/{d(2)}", lambda: f"{d(20)}", lambda: f"{d(9)}", lambda: f"{d(4)} {d(4)}", lambda: f"{d(10)}", lambda: f"{d(3)} {d(3)} {d(4)}",
        lambda: f"{word()}-{word()}-{word()}-{word()}-{d(4)}", lambda: f"{word()}_{word()}_{d(2)}_{word()}_{word()}", lambda: f"{word()}{d(1)}.{d(1)}-{word()}-{word()}.tar.gz", lambda: f"www.{word()}{d(2)}.{word()}{word()}.com",
        lambda: f"{hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}", lambda: f"{rng.randint(900, 999)}-{d(2)}-{d(4)}", lambda: f"{d(3)}-{d(2)}-0000", lambda: f"{d(4)}-{d(4)}", lambda: f"GB{d(2)} {d(4)} {d(4)} {d(4)} {d(3)}",
        lambda: f"{d(2)}-{d(2)}-{d(4)}", lambda: f"{d(3)}-{d(4)}-{d(3)}",
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 5))) + rng.choice([" ", ", ", ". ", "\n"])
            if rng.random() < 0.6:
                kind = rng.choice(KINDS)
                x = made[kind]()
                if kind == "secret":
                    text += rng.choice(['token = "', "api key: ", "password=", 'secret: "', "key '"]) if not _PREFIX.match(x) or rng.random() < 0.5 else ""
                spans.append((len(text), len(text) + len(x), kind))
            else:
                x = rng.choice(no)()
            text += x + rng.choice([" ", ", ", "!! ", "### ", '" ', "\n", "; "])
        out.append((text + word(), spans))
    return out


@cache
def fitted(rounds: int = 60, rate: float = 0.5, decay: float = 0.002) -> dict[tuple[str, str], float]:
    """Weights of greatest conditional likelihood on the examples (with a small pull to 0), by gradient steps with momentum."""
    data = []
    for text, spans in examples():
        true = set(spans)
        for tokens in stretches(text):
            ending: list[list[tuple[int, list[tuple[str, str]], bool]]] = [[] for _ in range(len(tokens) + 1)]
            for i, j, kind, f, _ in scored(text, tokens, {}):
                ending[j].append((i, [(kind, x) for x in f], (tokens[i][0], tokens[j - 1][1], kind) in true))
            data.append(ending)
    weights: dict[tuple[str, str], float] = {}
    speed: dict[tuple[str, str], float] = {}
    for _ in range(rounds):
        slope: dict[tuple[str, str], float] = {}
        for ending in data:
            n = len(ending) - 1
            own = [[(i, f, t, math.exp(min(50.0, sum(weights.get(x, 0.0) for x in f)))) for i, f, t in e] for e in ending]
            ahead = [1.0] + [0.0] * n
            for j in range(1, n + 1):
                ahead[j] = ahead[j - 1] + sum(ahead[i] * w for i, _, _, w in own[j])
            behind = [0.0] * n + [1.0]
            for j in range(n, 0, -1):
                behind[j - 1] += behind[j]
                for i, _, _, w in own[j]:
                    behind[i] += behind[j] * w
            for j in range(1, n + 1):
                for i, f, t, w in own[j]:
                    chance = ahead[i] * w * behind[j] / ahead[n]
                    for x in f:
                        slope[x] = slope.get(x, 0.0) + t - chance
        for x, g in slope.items():
            speed[x] = 0.8 * speed.get(x, 0.0) + rate * (g / len(data) * 10 - decay * weights.get(x, 0.0))
            weights[x] = weights.get(x, 0.0) + speed[x]
    return weights


def all_spans(text: str, weights: dict[tuple[str, str], float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base spans and those of the field that overlap none), each by kind as listed, then start."""
    found = base_spans(text)
    base = [(k, a, b) for k in KINDS[:4] for a, b in found[k]]
    starts, ends = [], []  # what the base spans cover, as intervals that don't touch
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    more = []
    for tokens in stretches(text):
        for kind, a, b in best(text, tokens, weights):
            at = bisect_left(starts, b)  # the last interval that starts before the span ends
            if not at or ends[at - 1] <= a:
                more.append((kind, a, b))
    return base, sorted({*base, *more}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_pii(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Per row of df: `keep`, counts by base kind, base_sha256, spans (kind:start:end, comma-joined), n_spans (their number)."""
    weights = fitted()
    written = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def rows_of(texts: list[bytes]) -> dict[str, pa.Array]:
        made = [all_spans(t.decode(), weights) for t in texts]
        counts = {f"n_{k}": pa.array([sum(s[0] == k for s in base) for base, _ in made], pa.int64()) for k in KINDS[:4]}
        return counts | {
            "base_sha256": pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in made], pa.string()),
            "spans": pa.array([written(spans) for _, spans in made], pa.string()),
            "n_spans": pa.array([len(spans) for _, spans in made], pa.int64()),
        }

    return map_texts(df, rows_of, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint", keep, text)


def redacted(text: str, weights: dict[tuple[str, str], float]) -> str:
    """The text with each span replaced by its kind in angle brackets; spans that overlap are replaced as one."""
    out, done = [], 0
    for kind, a, b in sorted(all_spans(text, weights)[1], key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(df: DataFrame, keep: list[str], text: str = "text", name: str = "redacted_text") -> DataFrame:
    """Per row of df: `keep` and the redacted text; null stays null."""
    weights = fitted()
    known = df[text].isNotNull()

    def rows_of(texts: list[bytes]) -> dict[str, pa.Array]:
        return {name: pa.array([redacted(t.decode(), weights) for t in texts], pa.string())}

    made = map_texts(df.withColumn("_known", known), rows_of, f"{name} string", [*keep, "_known"], text)
    return made.select(*keep, F.when(F.col("_known"), F.col(name)).alias(name))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"), ["doc_id"])
