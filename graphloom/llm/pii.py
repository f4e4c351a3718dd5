"""Personal data by candidate gradient boosting, in SQL expressions.

Generators with high recall propose spans of six kinds (email, ip, card, phone,
and secret and iban beyond the base patterns), which may overlap.  Each span
gets features of its format (digits, groups, separators, check sums, octets,
character classes) and of the words before it.  Boosted trees, turned to
expressions, score it; a threshold for each kind, set for precision on held-out
examples, selects spans.  Spans that fit the strict base patterns are always
kept.

The trees are trained here, on examples that ``examples`` makes from a seed:
formats in use and look-alikes (orders, versions, dates, sums, commits, paths),
set in the words that at most ``CONTEXTS`` documents have, if they are given.
Their features come from the same SQL expressions as those of documents; only
the example rows and the contexts, of 80 code points each, come to the driver.

Text positions are code points.  A pattern's matches are set off with a private
character, and positions are the running lengths of the pieces; where a text
holds that character itself, a replacement of the same length stands for it.
Patterns are possessive, so that matching takes linear time and no stack.

Defined cases: a null text is empty and has no spans; an empty table gives an
empty one; equal texts have equal spans; a very long text is read whole, and its
matches are gathered in runs of ``RUN``; an added span that overlaps a base span
of its kind is left out, and of added spans of a kind that overlap the first
stays; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table

#: Kinds with base patterns, and those that only the method finds.
KINDS = ("email", "ip", "card", "phone")
MORE = ("secret", "iban")
ALL = (*KINDS, *MORE)
MARK = ""
SEED = 17
EXAMPLES = 4_800
CONTEXTS = 400
ROUNDS, RATE, LEAVES_MIN = 40, 0.3, 8
PRECISION = 0.97
#: Matches are gathered in runs of so many pieces (an even number), then run by run.
RUN = 256

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Equivalent to the base patterns, leftmost and greedy, without backtracking over long runs.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?|\x20(?:at|AT)\x20)"
_DOT = r"(?:\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)"
_KEY = "A-Za-z0-9+/_"
#: Generators of further candidates of each kind.
WIDE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+{_AT}[{_LABEL}]{{1,63}}+(?:{_DOT}[{_LABEL}]{{1,63}}+){{1,4}}+",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9.+-])[3-6][0-9]{3}([\x20-]?)[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+.,/-])(?:00[1-9][0-9]{0,2}[\x20.-]?)?\(?0?[1-9][0-9]{1,3}\)?[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9.,/-][0-9]|[0-9])",
    # tokens of dotted parts come first, whole
    "secret": rf"(?<![{_KEY}.-])eyJ[{_KEY}-]{{8,}}+(?:\.[{_KEY}-]{{4,}}+){{1,4}}+(?![{_KEY}-])|(?<=[=:]\x20?[\x22\x27]?)(?<![{_KEY}-])[{_KEY}.-]{{8,256}}+={{0,2}}+(?![{_KEY}.-])|(?<![{_KEY}.-])(?=[A-Za-z+/_-]*+[0-9])[{_KEY}-]{{20,256}}+={{0,2}}+(?![{_KEY}-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
}
#: What a text must have for a kind's patterns to be tried.
NEEDS = {
    "email": ("contains(text, '@')", r"text rlike r'(?i)[\[({\x20]at[\])}\x20]' and (contains(text, '.') or text rlike r'(?i)dot')"),
    "ip": (r"text rlike r'[0-9]\.[0-9]'", r"text rlike r'[0-9A-Fa-f]:[0-9A-Fa-f:]'"),
    "card": (r"text rlike r'[0-9][\x20-]?[0-9]'", r"text rlike r'[0-9]{4}'"),
    "phone": (r"text rlike r'\+[0-9]'", r"text rlike r'[0-9][\x20.)-]+[0-9]'"),
    "secret": ("", rf"text rlike r'[=:]\x20?[\x22\x27]?[{_KEY}.-]{{8}}|[{_KEY}-]{{20}}'"),
    "iban": ("", r"text rlike r'[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{8}'"),
}
_SPAN = "array<struct<start:int,stop:int,found:string,before:string>>"

_DIGITS = "regexp_replace(c.found, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length({d})), 0, (s, i) -> s + if(i % 2 = 0, 2 * int(substring(reverse({d}), i, 1)) - if(int(substring(reverse({d}), i, 1)) > 4, 9, 0), int(substring(reverse({d}), i, 1)))) % 10 = 0"
).format(d=_DIGITS)
_OCTETS = r"forall(split(c.found, '[.]'), p -> length(regexp_replace(p, r'^0+(?=[0-9])', '')) <= 3 and int(right(concat('0', p), 3)) <= 255)"
_PLAIN = "replace(c.found, ' ', '')"
#: The remainder by 97 of the moved and spelled number, letter by letter.
_MOD97 = (
    f"aggregate(split(concat(substring({_PLAIN}, 5), substring({_PLAIN}, 1, 4)), ''), 0, "
    "(s, x) -> if(x = '', s, if(x rlike '[0-9]', (s * 10 + int(x)) % 97, (s * 100 + ascii(x) - 55) % 97))) = 1"
)
#: What a base match must pass.
VALID = {
    "email": "true",
    "ip": _OCTETS,
    "card": f"length({_DIGITS}) between 13 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 9 and 15",
}
FEATURES = {
    "digits": f"least(length({_DIGITS}), 40)",
    "length": "least(length(c.found), 80)",
    "groups": "least(size(regexp_extract_all(c.found, '([0-9]+)', 1)), 20)",
    "separators": r"least(length(regexp_replace(c.found, '[^\\x20-]', '')), 20)",
    "dots": "least(length(regexp_replace(c.found, '[^.]', '')), 20)",
    "slashes": "least(length(regexp_replace(c.found, '[^/]', '')), 20)",
    "plus": "if(startswith(c.found, '+'), 1, 0)",
    "parens": "if(contains(c.found, '('), 1, 0)",
    "luhn": f"case when length({_DIGITS}) between 12 and 19 then if({_LUHN}, 1, 0) else 0 end",
    "mod97": f"case when length(c.found) between 14 and 45 and c.found rlike '^[A-Z][A-Z][0-9][0-9][0-9A-Z ]+$' then if({_MOD97}, 1, 0) else 0 end",
    "first_group": r"least(length(regexp_extract(c.found, '([0-9]+)', 1)), 20)",
    "last_group": r"least(length(regexp_extract(c.found, '([0-9]+)[^0-9]*$', 1)), 20)",
    "odd_groups": r"least(size(regexp_extract_all(c.found, '(?<![0-9])([0-9]{1,2}|[0-9]{5,})(?![0-9])', 1)), 20)",
    "first": "coalesce(try_cast(substring(" + _DIGITS + ", 1, 1) as int), -1)",
    "letters": "if(c.found rlike '[A-Za-z]', 1, 0)",
    "hex": "if(c.found rlike '^[0-9a-fA-F]+$', 1, 0)",
    "classes": "if(c.found rlike '[a-z]', 1, 0) + if(c.found rlike '[A-Z]', 1, 0) + if(c.found rlike '[0-9]', 1, 0)",
    "changes": "least(size(regexp_extract_all(c.found, '([0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z])', 1)), 40)",
    "known": "if(c.found rlike '^(AKIA|ASIA|gh[pousr]_|glpat-|sk[-_]|xox[abprs]-|AIza|eyJ)', 1, 0)",
    "assigned": r"if(c.before rlike '[=:]\\x20?[\\x22\\x27]?$', 1, 0)",
    "quoted": r"if(c.before rlike '[\\x22\\x27]$', 1, 0)",
    "says_mail": "if(lower(c.before) rlike '(mail|contact|write|reach|correo|courriel)', 1, 0)",
    "says_net": "if(lower(c.before) rlike '(ip|host|server|addr|client|peer)', 1, 0)",
    "says_card": "if(lower(c.before) rlike '(card|visa|credit|debit|amex|pan|karte|carte|tarjeta|pay)', 1, 0)",
    "says_phone": "if(lower(c.before) rlike '(call|phone|tel|mobile|cell|fax|whatsapp|sms|contact|ruf|appel|llam)', 1, 0)",
    "says_secret": "if(lower(c.before) rlike '(token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)', 1, 0)",
    "says_other": "if(lower(c.before) rlike '(order|invoice|ref|version|isbn|issue|build|date|page|serial|item|ticket|lot)', 1, 0)",
    "says_hash": "if(lower(c.before) rlike '(commit|sha|md5|checksum|digest|uuid|hash|href|src|path|file|name|id.?=|id.?:|class)', 1, 0)",
}


def _located(pattern: str) -> str:
    """SQL for the matches of a pattern in ``text``: positions, the match, and 24 code points before it."""
    step = (
        "named_struct('pos', a.pos + length(p), 'odd', not a.odd, 'tail', right(concat(a.tail, p), 24), "
        "'out', if(a.odd, concat(a.out, array(named_struct('start', a.pos, 'stop', a.pos + length(p), 'found', p, 'before', a.tail))), a.out))"
    )
    none = f"cast(array() as {_SPAN})"
    # every other piece is a match; a run begins with a piece that is none
    run = f"aggregate(slice(ps, r * {RUN} + 1, {RUN}), named_struct('pos', b.pos, 'odd', false, 'tail', b.tail, 'out', {none}), (a, p) -> {step})"
    runs = f"aggregate(sequence(0, (size(ps) - 1) div {RUN}), named_struct('pos', 0, 'tail', '', 'out', {none}), (b, r) -> transform(array({run}), x -> named_struct('pos', x.pos, 'tail', x.tail, 'out', concat(b.out, x.out)))[0], b -> b.out)"
    return f"transform(array(split(regexp_replace(text, r'({pattern})', '{MARK}$1{MARK}'), '{MARK}')), ps -> {runs})[0]"


def _proposed(kind: str, wide: bool) -> str:
    return f"case when {NEEDS[kind][wide]} then {_located(WIDE[kind] if wide else BASE[kind])} else cast(array() as {_SPAN}) end"


def propose(texts: DataFrame) -> DataFrame:
    """Adds the base matches (``base_<kind>`` the valid ones, ``loose_<kind>`` the others) and further candidates (``wide_<kind>``)."""
    clean = texts.withColumn("text", F.expr(f"case when contains(text, '{MARK}') then translate(text, '{MARK}', '�') else text end"))
    found = clean.select("*", *[F.expr(_proposed(k, False)).alias(f"match_{k}") for k in KINDS], *[F.expr(_proposed(k, True)).alias(f"wide_{k}") for k in ALL])
    split = [F.expr(f"filter(match_{k}, c -> {VALID[k]})").alias(f"base_{k}") for k in KINDS]
    loose = [F.expr(f"filter(match_{k}, c -> not ({VALID[k]}))").alias(f"loose_{k}") for k in KINDS]
    return found.select("*", *split, *loose).drop(*[f"match_{k}" for k in KINDS])


def _candidates(kind: str, base: bool = False) -> str:
    """SQL: the spans of a kind that the trees score."""
    return f"wide_{kind}" if kind in MORE else f"concat(wide_{kind}, loose_{kind}, base_{kind})" if base else f"concat(wide_{kind}, loose_{kind})"


def contexts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = CONTEXTS) -> list[str]:
    """Pieces of 80 code points of about ``sample`` documents, chosen by a hash of the id; the bound is the parameter's."""
    total = docs.select(F.lit(1)).count()
    key = F.pmod(F.xxhash64(F.lit(5), F.col(id_col).cast("string")), F.lit(1 << 30))
    some = docs.where((key < (1 << 30) * sample // max(total, 1)) & F.col(text_col).isNotNull()).select(key.alias("key"), F.col(text_col).cast("string").alias("text"))
    begin = F.pmod(F.col("key"), F.greatest(F.length("text") - 80, F.lit(1))).cast("int") + 1
    got = some.select("key", F.expr("text").substr(begin, F.lit(80)).alias("piece")).orderBy("key", "piece").limit(2 * sample).collect()
    return [r["piece"] for r in got if r["piece"]]


def examples(n: int = EXAMPLES, seed: int = SEED, pieces: tuple[str, ...] = ()) -> list[tuple[str, str, int]]:
    """(text, kind, is personal) rows: one span with words before and after it, those of ``pieces`` if there are any."""
    rng = np.random.default_rng(seed)

    def pick(*xs):
        return xs[rng.integers(len(xs))]

    def digits(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def drawn(alphabet: str, k: int) -> str:
        return "".join(alphabet[x] for x in rng.integers(0, len(alphabet), k))

    def luhn(body: str) -> str:
        for last in "0123456789":
            d = [int(x) for x in reversed(body + last)]
            if sum(d[::2] + [2 * x - 9 * (x > 4) for x in d[1::2]]) % 10 == 0:
                return body + last
        raise AssertionError

    def unlucky(k: int) -> str:
        """A number whose check digit is wrong."""
        d = luhn(digits(k - 1))
        return d[:-1] + str((int(d[-1]) + int(rng.integers(1, 10))) % 10)

    def iban(country: str, rest: str) -> str:
        spelled = "".join(str(int(x, 36)) for x in rest + country + "00")
        return f"{country}{98 - int(spelled) % 97:02d}{rest}"

    def spaced(d: str, sep: str) -> str:
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def word() -> str:
        return "".join(pick("ba", "to", "ri", "sel", "mon", "ka", "du") for _ in range(rng.integers(1, 4)))

    lower, upper, ten = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    neutral = ("and", "the", "with", "on", "of", "is")
    says = {
        "email": ("mail me at", "contact", "e-mail:", "write to"), "ip": ("ip", "host", "server", "client"), "card": ("card", "visa", "credit card", "paid with"),
        "phone": ("call", "phone:", "tel", "mobile", "whatsapp", "fax"), "iban": ("iban", "account", "konto", "pay to", "transfer to"),
        "secret": ("token", "secret", "password", "api_key", "access_key", "auth", "api-key", "pwd"),
    }
    other = ("order", "invoice no", "version", "isbn", "ref", "ticket", "serial", "build", "lot", "page")
    out = []
    for i in range(n):
        kind, yes = ALL[i % 6], int(i // 6 % 2)
        before = pick(*says[kind], *neutral) if yes else pick(*other, *other, *neutral)
        joint = " "
        if kind == "email":
            at, dot = pick((" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "."), (" at ", " dot "), (" AT ", " DOT "), ("{at}", "{dot}"))
            span = f"{word()}{pick('', '.', '_')}{word()}{at}{word()}{dot}{pick('com', 'org', 'net', 'de')}" if yes else pick(f"{digits(2)}[at]{digits(3)}.{digits(2)}", f"{word()} at {word()}.{word()}", f"{word()} at {digits(2)}.{digits(2)}")
        elif kind == "ip":
            groups = [f"{x:x}" for x in rng.integers(0, 65536, 8)]
            span = pick(":".join(groups), f"{':'.join(groups[:3])}::{':'.join(groups[5:])}", f"fe80::{groups[0]}:{groups[1]}:{groups[2]}:{groups[3]}", ".".join(map(str, rng.integers(1, 256, 4)))) if yes else pick(".".join(digits(4) for _ in range(4)), ":".join(digits(2) for _ in range(8)), f"{digits(3)}.{digits(4)}.{digits(5)}.{digits(4)}", f"{digits(1)}::{digits(1)}")
        elif kind == "card":
            d = luhn(pick("4", "51", "54", "37", "6011") + digits(11))
            d = luhn(d[:-1]) if yes else pick(unlucky(13), unlucky(16), unlucky(16), unlucky(15), unlucky(17), digits(rng.integers(2, 12)), digits(rng.integers(20, 60)), " ".join(digits(10)))
            span = spaced(d, pick("", " ", "-"))
            # a date or a code after it makes one run of digits of both
            span += pick("", "", f" {digits(2)}/{digits(2)}", f" {digits(3)}") if yes else ""
        elif kind == "phone":
            area = str(rng.integers(200, 990))
            span = (
                pick(f"({area}) {digits(3)}-{digits(4)}", f"{area}-{digits(3)}-{digits(4)}", f"{area} {digits(3)} {digits(4)}", f"{area}.{digits(3)}.{digits(4)}", f"0049 {area} {digits(3)} {digits(4)}", f"0{area[:2]} {digits(4)} {digits(4)}", f"+1 ({area}) {digits(3)}-{digits(4)}", f"+49 {area} {digits(7)}")
                if yes
                else pick(f"{rng.integers(1990, 2030)} {digits(4)} {digits(2)}", f"{digits(2)}-{digits(4)}-{digits(3)}-{digits(2)}", f"978-{digits(4)}-{digits(4)}-{digits(2)}", f"{digits(2)} {digits(3)} {digits(3)}", f"+{digits(6)}", f"+{digits(19)}", f"{rng.integers(1990, 2030)}-{digits(4)}-{digits(2)}", ".".join(map(str, rng.integers(10, 256, 4))), ".".join(map(str, rng.integers(100, 256, 4))))
            )
        elif kind == "secret":
            hexes = drawn("0123456789abcdef", pick(32, 40, 64))
            mixed = drawn(lower + upper + ten, int(rng.integers(20, 64)))
            known = pick(f"AKIA{drawn(upper + ten, 16)}", f"ghp_{drawn(lower + upper + ten, 36)}", f"sk-{drawn(lower + upper + ten, 32)}", f"xoxb-{digits(11)}-{drawn(lower + ten, 24)}", ".".join((f"eyJ{drawn(lower + upper + ten, 33)}", f"eyJ{drawn(lower + upper + ten + '-_', 60)}", drawn(lower + upper + ten + "-_", 43))))
            if yes:
                joint = pick(' = "', '="', ": ", ' = "', "=", ": '")
                before = pick(*says[kind]) if joint else before
                span = pick(hexes, hexes, mixed, known, drawn(lower + upper + ten, int(rng.integers(10, 20))))
                if pick(0, 0, 0, 1):
                    before, joint, span = pick(*neutral), " ", known
            else:
                joint = pick(" ", ' = "', ": ", "=")
                before = pick("commit", "sha1", "md5", "checksum", "id", "path", "file", "name", "class", "version", "href", "date", "title", "lang")
                span = pick(hexes, f"{word()}/{word()}/{word()}{digits(1)}/{word()}-{word()}.{word()}", f"the-{digits(2)}-{word()}-{word()}-{word()}-{word()}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{word()}{word()}{word()}", f"{word()}_{word()}_{digits(2)}_{word()}_{word()}", f"{digits(1)}.{digits(1)}.{digits(2)}-{word()}", digits(24), f"/{digits(4)}/{digits(2)}/{word()}-{word()}-{word()}", "=" * int(rng.integers(8, 30)), "-" * int(rng.integers(8, 30)), "1" + "0" * int(rng.integers(20, 30)))
        else:
            body = iban(*pick(("DE", digits(18)), ("GB", drawn(upper, 4) + digits(14)), ("FR", digits(23)), ("ES", digits(20)), ("NL", drawn(upper, 4) + digits(10))))
            wrong = body[:2] + f"{(int(body[2:4]) + int(rng.integers(1, 96))) % 100:02d}" + body[4:]
            span = spaced(body if yes else pick(wrong, wrong, f"{drawn(upper, 2)}{digits(2)}{drawn(upper, 4)}{digits(8)}"), pick("", " "))
        ends = {' = "': '"', '="': '"', ": '": "'"}.get(joint, "")
        first = f"{word()}"
        last = word()
        if pieces:
            # the words of a document, cut at blanks
            first, last = (" ".join(str(pick(*pieces)).split()[1:-1][-k:]) or word() for k in (3, 4))
        if pieces and yes and joint == " " and pick(0, 1):
            before = ""
        out.append((f"{first} {before}{joint if before else ' '}{span}{ends} {last}", kind, yes))
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list[tuple]]:
    """Boosted trees of depth two for the logistic loss: the prior, and (feature, cut, (side, side)) trees whose sides are (feature, cut, low, high)."""
    prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin, trees = np.full(len(y), prior), []
    cuts = [(f, float(c)) for f in range(x.shape[1]) for c in np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25), method="nearest"))]
    below = np.stack([x[:, f] <= c for f, c in cuts], axis=1).astype(np.float64)

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
        """The cut of the rows with the largest gain; one that keeps all rows together if none may be made."""
        low_n, low_g, low_h = (np.where(rows, v, 0.0) @ below for v in (np.ones(len(rows)), g, h))
        all_n, all_g, all_h = rows.sum(), g[rows].sum(), h[rows].sum()
        gain = low_g**2 / (low_h + 1) + (all_g - low_g) ** 2 / (all_h - low_h + 1)
        gain[(low_n < LEAVES_MIN) | (all_n - low_n < LEAVES_MIN)] = -1.0
        k = int(gain.argmax())
        return cuts[k] if gain[k] > 0 else (0, float(x[:, 0].max()))

    def leaf(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> float:
        return round(float(rate * g[rows].sum() / (h[rows].sum() + 1)), 6) if rows.any() else 0.0

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        f, c = best(np.ones(len(y), dtype=bool), g, h)
        sides = []
        for side in (x[:, f] <= c, x[:, f] > c):
            f2, c2 = best(side, g, h)
            low, high = side & (x[:, f2] <= c2), side & (x[:, f2] > c2)
            sides.append((f2, c2, leaf(low, g, h), leaf(high, g, h)))
            margin[low] += sides[-1][2]
            margin[high] += sides[-1][3]
        trees.append((f, c, tuple(sides)))
    return prior, trees


def margins(x: np.ndarray, prior: float, trees: list[tuple]) -> np.ndarray:
    out = np.full(len(x), prior)
    for f, c, sides in trees:
        for side, (f2, c2, low, high) in zip((x[:, f] <= c, x[:, f] > c), sides, strict=True):
            out += np.where(side, np.where(x[:, f2] <= c2, low, high), 0.0)
    return out


def tree_sql(prior: float, trees: list[tuple], names: list[str]) -> str:
    """The margin as SQL over a struct ``f`` of features."""
    one = lambda side: f"if(f.{names[side[0]]} <= {side[1]!r}D, {side[2]!r}D, {side[3]!r}D)"
    return " + ".join([f"{prior!r}D", *(f"if(f.{names[f]} <= {c!r}D, {one(sides[0])}, {one(sides[1])})" for f, c, sides in trees)])


def _featured(source: str) -> str:
    """SQL: the candidates of a column with their features as a struct ``f``."""
    made = ", ".join(f"'{n}', double({e})" for n, e in FEATURES.items())
    return f"transform({source}, c -> named_struct('start', c.start, 'stop', c.stop, 'f', named_struct({made})))"


NAMES = list(FEATURES)
#: For each kind the prior, the trees and the threshold.
Model = tuple[tuple[float, tuple, float], ...]


@lru_cache(maxsize=4)
def _boosted(rows: tuple[tuple[float, ...], ...]) -> Model:
    """Trees for each kind; rows end with the kind's number and the truth."""
    data, out = np.array(rows), []
    for k in range(len(ALL)):
        own = data[data[:, -2] == k]
        x, y = own[:, :-2], own[:, -1]
        learn = np.arange(len(y)) % 3 != 0
        prior, trees = boost(x[learn], y[learn])
        m, truth = margins(x[~learn], prior, trees), y[~learn]
        good = [t for t in sorted(set(m.tolist())) if truth[m >= t].mean() >= PRECISION]
        out.append((prior, tuple(trees), min(good) - 1e-9 if good else 1e9))
    return tuple(out)


def example_rows(spark: SparkSession, made: list[tuple[str, str, int]]) -> list[tuple[float, ...]]:
    """The features of each candidate in made examples, the number of its kind, and at last whether it is personal data."""
    rows = spark.createDataFrame(made, "text string, kind string, yes int")
    parts = propose(rows)
    # a span is personal data of its own kind only: the other kinds' candidates are look-alikes
    each = [F.expr(f"transform({_featured(_candidates(k, True))}, c -> named_struct('number', {i}, 'yes', if(kind = '{k}', yes, 0), 'f', c.f))") for i, k in enumerate(ALL)]
    got = parts.select(F.explode(F.concat(*each)).alias("c")).select("c.number", "c.yes", "c.f.*").collect()
    return [(*(float(r[n]) for n in NAMES), float(r["number"]), float(r["yes"])) for r in got]


def fit(spark: SparkSession, pieces: list[str] | None = None) -> Model:
    """The trees and thresholds of each kind, from the made examples, half of them in the given contexts."""
    made = examples(EXAMPLES // 2) + examples(EXAMPLES // 2, SEED + 1, tuple(pieces or ()))
    return _boosted(tuple(sorted(example_rows(spark, made))))


def find(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, the counts of base spans, and spans (``base`` and ``spans``: arrays of kind, start, stop)."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = propose(texts).drop("text")
    scored = lambda k, prior, trees, cut: f"filter({_featured(_candidates(k))}, s -> aggregate(array(s.f), 0D, (z, f) -> {tree_sql(prior, list(trees), NAMES)}) >= {cut!r}D)"
    picked = parts.select("*", *[F.expr(scored(k, *own)).alias(f"more_{k}") for k, own in zip(ALL, model, strict=True)])
    # added spans: sorted, clear of base spans and of each other
    clear = {
        k: f"aggregate(array_sort(transform(more_{k}, s -> named_struct('start', s.start, 'stop', s.stop))), cast(array() as array<struct<start:int,stop:int>>), "
        f"(out, s) -> if({f'exists(base_{k}, b -> b.start < s.stop and s.start < b.stop) or ' if k in KINDS else ''}coalesce(element_at(out, -1).stop > s.start, false), out, concat(out, array(s))))"
        for k in ALL
    }
    clear = {k: f"if(size(more_{k}) = 0, cast(array() as array<struct<start:int,stop:int>>), {x.replace('element_at(out, -1)', 'try_element_at(out, -1)')})" for k, x in clear.items()}
    added = picked.select("id", *[f"base_{k}" for k in KINDS], *[F.expr(clear[k]).alias(f"added_{k}") for k in ALL])
    span = lambda k, what: f"transform({what}, s -> named_struct('kind', '{k}', 'start', s.start, 'stop', s.stop))"
    base = ", ".join(span(k, f"base_{k}") for k in KINDS)
    every = ", ".join(f"array_sort(concat({span(k, f'base_{k}')}, {span(k, f'added_{k}')}))" if k in KINDS else span(k, f"added_{k}") for k in ALL)
    counts = [F.expr(f"bigint(size(base_{k}))").alias(f"n_{k}") for k in KINDS]
    return added.select(F.col("id").alias(id_col), *counts, F.expr(f"concat({base})").alias("base"), F.expr(f"concat({every})").alias("spans"))


def written(spans: str) -> str:
    """SQL: spans as kind:start:end, comma-joined."""
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.stop)), ',')"


def redact(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and the text with each span replaced by its kind in angle brackets; overlapping spans are cut once."""
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("doc"))
    found = find(keyed.select("doc", F.col("doc.text").alias("text")), model, id_col="doc")
    cut = (
        "aggregate(array_sort(transform(spans, s -> named_struct('start', s.start, 'stop', s.stop, 'kind', s.kind))), named_struct('at', 0, 'out', ''), "
        "(a, s) -> if(s.start < a.at, named_struct('at', greatest(a.at, s.stop), 'out', a.out), named_struct('at', s.stop, 'out', concat(a.out, substring(doc.text, a.at + 1, s.start - a.at), '<', s.kind, '>'))), "
        "a -> concat(a.out, substring(doc.text, a.at + 1)))"
    )
    return found.select(F.col("doc.id").alias(id_col), F.expr(cut).alias(text_col))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of all ``documents``; ``n_spans`` counts all spans."""
    docs = table(spark, sf_dir, "documents")
    out = find(docs, fit(spark, contexts(docs)))
    return out.select(
        "doc_id", *[f"n_{k}" for k in KINDS], F.expr(f"sha2({written('base')}, 256)").alias("base_sha256"), F.expr(written("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans")
    )
