"""Personal data: base patterns, and spans that a classifier adds, trained from voting labelers by expectation-maximisation."""

from __future__ import annotations

import bisect
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, ship, slices, table, with_fields

#: Listed order of kinds; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "mac", "secret", "person", "address")
ROUNDS, STEPS, CUT = 50, 300, 0.9

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
# A failed start in a run of digits fails from every later digit of the run too.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of local part, @ and domain, in one pass over the @ signs."""
    done = 0
    at = text.find("@")
    while at >= 0:
        tail = text[done:at]
        size = LOCAL.match(tail[::-1]).end()
        found = DOMAIN.match(text, at) if size else None
        if found:
            yield at - size, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base, in order of start, then kind; matches that fail their test are dropped."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40 and 12 <= len(d := digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# Candidates beyond the base: wide patterns by kind; one of the strings must stand in the text for it to be tried. Two
# capitalised words are a candidate only where the first is a known first name.
WIDE = (
    (0, ("[at]", "(at)"), re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64}(?: ?[\[(]dot[\])] ?|\.)[A-Za-z]{2,12}\b")),
    (3, ("-",), re.compile(r"(?<![\w+-])\(?[2-9][0-9]{2}\)?[ .-]{1,2}[0-9]{3}[.-][0-9]{4}(?![\w-])")),
    (3, ("00",), re.compile(r"(?<![\w+])00[1-9][0-9](?:[ .-]?[0-9]{2,4}){3,5}(?![\w-])")),
    (4, ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9"), re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")),
    (5, ("-",), re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    (6, (":",), re.compile(r"(?<![\w:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![\w:])")),
    (7, ("AKIA", "gh", "sk-", "xox", "key", "ecret", "oken", "assw", "KEY", "ECRET", "OKEN", "ASSW"), re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,80}|xox[abpr]-[A-Za-z0-9-]{10,72}|(?i:api[_-]?key|secret|token|passw(?:or)?d)[\"']? ?[:=] ?[\"']?[A-Za-z0-9_/+=.-]{8,80})")),
    (8, ("Mr", "Ms", "Dr", "Prof", "Mme", "Mlle", "Herr", "Frau", "Sr"), re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Mme|Mlle|Herr|Frau|Sr|Sra)\.? [A-Z][a-zà-ÿ]{1,20}(?: [A-Z][a-zà-ÿ]{1,20}){0,2}")),
    (8, (" ",), re.compile(r"\b[A-Z][a-zà-ÿ]{1,20} [A-Z][a-zà-ÿ]{1,20}\b")),
    (9, (" St", " Av", " R", " L", " Dr", " Bo", " Bl", " C", "rue ", "avenue ", "calle ", "avenida ", "straße", "strasse", "weg ", "platz "), re.compile(r"\b[0-9]{1,5} (?:[A-Z][a-z]{1,20} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct)\b|\b(?:rue|avenue|calle|avenida) [A-Za-zà-ÿ' ]{3,30},? [0-9]{1,4}\b|\b[A-Z][a-zà-ÿ]{2,20}(?:straße|strasse|weg|platz) [0-9]{1,4}\b")),
)

CUES = (
    ("mail", "e-mail", "contact", "correo", "courriel", "write to", "@"),
    ("ip", "host", "server", "address", "adresse", "ping", "login from"),
    ("card", "visa", "mastercard", "amex", "carte", "karte", "tarjeta", "payment"),
    ("tel", "phone", "call", "fax", "mobile", "cell", "téléphone", "telefon", "teléfono", "whatsapp"),
    ("iban", "bank", "konto", "compte", "cuenta", "account", "bic"),
    ("ssn", "social", "security number", "tax id", "identity"),
    ("mac", "device", "interface", "ethernet", "wlan", "address"),
    ("key", "secret", "token", "password", "credential", "login"),
    ("name", "signed", "dear", "contact", "by", "regards", "from"),
    ("address", "lives", "street", "adresse", "dirección", "anschrift", "zip", "city"),
)
NOT_CUES = ("version", "isbn", "issn", "figure", "section", "chapter", "rfc", "serial", "price", "score", "page", "build", "doi")
# Gazetteers: common first names of English, German, French and Spanish speakers, words of streets, top-level domains
# and countries that give account numbers.
FIRST_NAMES = frozenset((
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen christopher lisa daniel nancy matthew betty anthony "
    "margaret mark sandra donald ashley steven kimberly paul emily andrew donna joshua michelle kenneth carol kevin amanda brian melissa george deborah edward stephanie ronald rebecca timothy laura "
    "peter hans klaus wolfgang jürgen dieter manfred uwe stefan andreas matthias sabine monika petra ursula renate helga gisela ingrid katrin heike anke jana lukas felix "
    "jean pierre michel andré philippe alain bernard jacques françois marie nathalie isabelle sylvie catherine martine christine sophie camille julien nicolas antoine chloé léa manon "
    "juan josé carlos luis antonio manuel francisco javier miguel pedro alejandro fernando sergio carmen maría josefa isabel dolores pilar teresa lucía elena marta rosa jose maria ana anna julia emma"
).split())
PLACES = frozenset((
    "street st avenue ave road rd lane ln drive dr boulevard blvd court ct place pl square sq terrace way highway hwy parkway close crescent "
    "rue chemin allée impasse quai cours route faubourg calle avenida plaza paseo camino carretera ronda straße strasse weg platz allee gasse ufer damm ring"
).split())
DOMAINS = frozenset("com org net edu gov mil int info biz name io co me tv app dev ai eu de fr es be uk nl it at ch lu pt ie dk se no fi pl cz gr ro hu ca us mx br ar cl au nz jp cn in za".split())
COUNTRIES = frozenset("AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT JO KW KZ LB LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR VG XK".split())


def iban_holds(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote: 1 for personal data, -1 against, 0 for none."""
    span = text[start:end]
    d = digits(span)
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    shape = 0  # a strict pattern
    if kind == 3:
        shape = 1 if 9 <= len(d) <= 15 and (span[0] == "(" or span[3:4] in "-. " or span.startswith("00")) else -1
    elif kind in (5, 6):
        shape = 1
    elif kind == 4:
        shape = 1 if span[:2] in COUNTRIES else -1
    elif kind == 7:
        shape = 1 if span[:4] in ("AKIA", "ghp_", "sk-", "xoxb", "xoxp") or (len(d) >= 2 and len(span) >= 20) else -1
    elif kind in (0, 8, 9):
        shape = 1 if kind == 0 or span.count(" ") >= 2 else 0
    proof = 0  # a checksum or a range
    if kind == 4:
        proof = 1 if iban_holds(span) else -1
    elif kind == 5:
        proof = -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
    elif kind == 3:
        proof = -1 if len(set(d)) < 3 else 0
    elif kind == 7:
        proof = 1 if len(set(re.split(r"[:= \"']+", span)[-1])) >= 8 else -1
    elif kind == 6:
        proof = -1 if len(set(span.replace(":", ""))) < 2 else 1
    near = before + span.lower() if kind == 7 else before
    cue = 1 if any(c in near for c in CUES[kind]) else 0
    against = -1 if any(c in before for c in NOT_CUES) or after[:1] in "%=" and after[:1] else 0
    words = [w for w in re.split(r"[^\w]+", span.lower()) if w]
    known = 0  # a gazetteer
    if kind == 8:
        known = 1 if any(w in FIRST_NAMES for w in words) else -1
    elif kind == 9:
        known = 1 if any(w in PLACES for w in words) else 0
    elif kind == 0:
        known = 1 if words and words[-1] in DOMAINS else -1
    edge = -1 if (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()) else 1 if not text[end : end + 1] or text[end : end + 1] in " .,;)\n\"'" else 0
    return shape, proof, cue, against, known, edge


LABELERS = 6
#: Buckets of the word before a span, and kinds of what follows it: end, white space, closing mark, letter or digit, other.
BEFORE, AFTER = 32, 5
FEATURES = len(KINDS) + 2 * LABELERS + BEFORE + 1 + AFTER + 3
#: The classifier is fitted on all patterns of features up to this many, beyond on the most frequent ones.
PATTERNS = 100_000
LAST_WORD = re.compile(r"(\w+)\W{0,3}$")


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, tuple[int, ...]]]:
    """(start, kind, end, votes) of spans beyond the base; none overlaps the base or one before it."""
    found = [(m.start(), kind, m.end()) for kind, needles, pattern in WIDE if any(n in text for n in needles) for m in pattern.finditer(text) if needles != (" ",) or m.group().split(" ")[0].lower() in FIRST_NAMES]
    if not found:
        return []
    starts, ends = [a for a, _, _ in base], list(itertools.accumulate((b for _, _, b in base), max))
    out, far = [], 0
    for a, kind, b in sorted(found):
        before = bisect.bisect_left(starts, b)
        if a >= far and not (before and ends[before - 1] > a):
            far = b
            out.append((a, kind, b, votes(text, kind, a, b)))
    return out


def context(text: str, start: int, end: int) -> tuple[int, int]:
    """The bucket of the word before a span, 0 for none, and the kind of what follows it."""
    word = LAST_WORD.search(text[max(0, start - 30) : start])
    after = text[end : end + 1]
    kind = 0 if not after else 1 if after.isspace() else 2 if after in ".,;:!?)]}\"'" else 3 if after.isalnum() else 4
    return 1 + zlib.crc32(word[1].lower().encode()) % BEFORE if word else 0, kind


def features(kind: int, vote: tuple[int, ...], size: int, n_digits: float, before: int = 0, after: int = 0) -> np.ndarray:
    out = np.zeros(FEATURES)
    out[kind] = 1
    for k, v in enumerate(vote):
        if v:
            out[len(KINDS) + 2 * k + (v < 0)] = 1
    out[len(KINDS) + 2 * LABELERS + before] = 1
    out[len(KINDS) + 2 * LABELERS + BEFORE + 1 + after] = 1
    out[-3:] = 1, min(size, 60) / 60, n_digits / max(1, size)
    return out


def reliabilities(patterns: dict[tuple, int]) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over counts of (votes): the prior and P(vote | class), class 1 being personal data.

    The start leans on the labelers being better than chance; votes are independent given the class.
    """
    votes_, n = np.array([p for p in patterns], int).reshape(-1, LABELERS), np.array(list(patterns.values()), float)
    table_ = np.full((2, LABELERS, 3), 1 / 3)  # for votes -1, 0, 1
    table_[1] = [0.1, 0.4, 0.5]
    table_[0] = [0.5, 0.4, 0.1]
    prior = 0.5
    for _ in range(ROUNDS if len(n) else 0):
        like = np.stack([np.prod([table_[c, k][votes_[:, k] + 1] for k in range(LABELERS)], axis=0) for c in (0, 1)])
        post = prior * like[1] / (prior * like[1] + (1 - prior) * like[0] + 1e-300)
        prior = float(np.clip((post * n).sum() / n.sum(), 0.05, 0.95))
        for c, w in ((1, post * n), (0, (1 - post) * n)):
            for k in range(LABELERS):
                count = np.array([w[votes_[:, k] == v].sum() for v in (-1, 0, 1)]) + np.array([0.1, 0.4, 0.5] if c else [0.5, 0.4, 0.1]) * 10
                table_[c, k] = count / count.sum()
    return prior, table_


def posterior(vote: tuple[int, ...], prior: float, table_: np.ndarray) -> float:
    like = [np.prod([table_[c, k, v + 1] for k, v in enumerate(vote)]) for c in (0, 1)]
    return float(prior * like[1] / (prior * like[1] + (1 - prior) * like[0] + 1e-300))


def train(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels; row k counts n[k] times."""
    w = np.zeros(x.shape[1])
    for _ in range(STEPS if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 1.0 * (x.T @ (n * (p - y)) / n.sum() + 1e-3 * w)
    return w


SPAN = "array<struct<start:int,kind:int,end:int,votes:array<int>,size:int,n_digits:int,before:int,after:int>>"
FOUND = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("votes", pa.list_(pa.int32())), *((c, pa.int32()) for c in ("size", "n_digits", "before", "after"))]))


def _span(text: str, a: int, kind: int, b: int, vote) -> dict:
    before, after = context(text, a, b) if vote else (0, 0)
    return {"start": a, "kind": kind, "end": b, "votes": list(vote), "size": b - a, "n_digits": len(digits(text[a:b])) if vote else 0, "before": before, "after": after}


def _look(text: str, keep: list[str]):
    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                base, more = [], []
                for t in part.column(text).to_pylist():
                    own = base_spans(t or "")
                    base.append([_span(t, a, k, b, ()) for a, k, b in own])
                    more.append([_span(t, a, k, b, v) for a, k, b, v in candidates(t or "", own)])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(base, FOUND), pa.array(more, FOUND)], [*keep, "base", "more"])

    return run


def look(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, base spans and candidates with their votes, written once: every later step reads these, not the texts."""
    ship(docs.sparkSession)
    schema = with_fields(docs.select(*keep).schema, f"base {SPAN}, more {SPAN}")
    rows = docs.select(*dict.fromkeys([*keep, text]))
    return Work(docs.sparkSession, "pii").table(rows.mapInArrow(_look(text, list(keep)), schema), "spans")


def fit(spans: DataFrame) -> np.ndarray:
    """Weights of the span classifier. Reliabilities come from all candidates' votes, counted (at most 3**6 patterns);
    the classifier is trained on their posteriors over all candidates, as counts of equal features, of which the
    PATTERNS most frequent come to the driver. Sizes count up to 60, shares of digits in twentieths."""
    c = spans.select(F.explode("more").alias("c")).select("c.*")
    share = F.floor(F.col("n_digits") / F.greatest(F.lit(1), F.col("size")) * 20).cast("int")
    c = c.select("kind", "votes", F.least("size", F.lit(60)).alias("size"), share.alias("share"), "before", "after")
    counted = c.groupBy(*c.columns).agg(F.count("*").alias("n"))
    patterns = {tuple(r.votes): r.n for r in counted.groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    rows = [tuple(r) for r in counted.orderBy(F.desc("n"), *c.columns).limit(PATTERNS).collect()]
    prior, table_ = reliabilities(dict(sorted(patterns.items())))
    chance = {v: posterior(v, prior, table_) for v in patterns}
    x = np.array([features(k, tuple(v), size, share / 20 * size, b, a) for k, v, size, share, b, a, _ in rows]).reshape(len(rows), FEATURES)
    return train(x, np.array([chance[tuple(r[1])] for r in rows]), np.array([r[-1] for r in rows], float))


def accept(s: dict, weights: np.ndarray) -> bool:
    """Whether the classifier takes a candidate."""
    share = int(s["n_digits"] / max(1, s["size"]) * 20) / 20
    size = min(60, s["size"])
    x = features(s["kind"], tuple(s["votes"]), size, share * size, s["before"], s["after"])
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))) >= CUT


def chosen(base: list[dict], more: list[dict], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """All spans in order: the base and the candidates that are taken."""
    return sorted((s["start"], s["kind"], s["end"]) for s in [*base, *(s for s in more if accept(s, weights))])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _choose(weights: np.ndarray, keep: list[str]):
    def run(batches):
        for batch in batches:
            base_, all_, counts = [], [], []
            for base, more in zip(batch.column("base").to_pylist(), batch.column("more").to_pylist(), strict=True):
                own = [(s["start"], s["kind"], s["end"]) for s in base]
                base_.append(joined(own))
                all_.append(joined(chosen(base, more, weights)))
                counts.append([sum(k == kind for _, k, _ in own) for kind in range(4)])
            n = np.array(counts, np.int64).reshape(-1, 4)
            columns = [*[batch.column(c) for c in keep], *[pa.array(n[:, k]) for k in range(4)], pa.array(base_, pa.string()), pa.array(all_, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return run


def find_pii(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_email, n_ip, n_card, n_phone (base), base and spans (kind:start:end in code points, comma-joined).

    Every whole text; null and empty texts have no spans. Base spans always stay, added ones never overlap them.
    Rows are independent of each other but for the labelers' reliabilities, which all candidates give; keep must not
    name an added column.
    """
    keep = list(keep)
    found = look(docs, text, tuple(keep))
    schema = with_fields(found.select(*keep).schema, "n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
    return found.mapInArrow(_choose(fit(found), keep), schema)


def _redact(weights: np.ndarray, text: str):
    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                out = []
                for t, base, more in zip(*(part.column(c).to_pylist() for c in (text, "base", "more")), strict=True):
                    at, pieces = 0, []
                    for a, k, b in chosen(base, more, weights):
                        if a >= at:
                            pieces += [t[at:a], f"[{KINDS[k].upper()}]"]
                        at = max(at, b)
                    out.append("".join([*pieces, t[at:]]) if at else t)
                done = part.set_column(part.schema.get_field_index(text), text, pa.array(out, pa.string()))
                yield done.select([c for c in done.schema.names if c not in ("base", "more")])

    return run


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets; of overlapping spans the first names it.

    Null and empty texts stay. Texts are searched once: the rows are written with what was found in them.
    """
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    own = f"c{docs.columns.index(text)}"
    found = look(plain, own, tuple(plain.columns))
    return found.mapInArrow(_redact(fit(found), own), plain.schema).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
