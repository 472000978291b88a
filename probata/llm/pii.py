"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

Base spans (email, ip, card, phone) are what fixed patterns and checks find; they are never dropped. Further candidates
are wide: long and grouped numbers, streets and addresses with a written-out at sign, runs of capitalised words, long runs
of mixed letters and digits, dates. Labelers of three sorts vote yes, no or nothing on every candidate: patterns (does
the shape fit, does a check digit hold, is the piece random enough), gazetteers (given names, streets, common words, words
that announce the kind or other numbers) and context (what stands before and after, a sentence's start, an assignment,
repetition). The votes of the whole corpus, counted by pattern, go to expectation-maximisation, which estimates for each
kind how often each labeler is right and how often a candidate is personal data. Some are known: base spans are what the
kinds they are like are, and a candidate is not if what stands before announces something else and nothing announces the
kind, or if it has a card's length, fails its check digit and nothing announces it. The share of a kind stays between 0.05
and 0.95, so a corpus whose candidates all look alike doesn't settle what they are. A logistic classifier of spans for each
kind is then trained on the posterior of each pattern of votes and features, weighted by its count, so nothing is sampled:
the distinct patterns are bounded by the number of labelers and features. Its weights are drawn to what the features mean to
the labelers, so a feature that never varies in the corpus keeps that meaning instead of passing into a constant. Candidates that it gives at least ``least`` are added as ``number``, ``address``, ``name``,
``secret``, ``date`` or ``mailbox``.

Offsets count code points, ends are exclusive. Defined results: a null text is an empty one, and has no span; base kinds
are matched each by itself, so spans of different kinds may overlap; an added span never overlaps a base span or one added
before it; rows that repeat are judged each by itself; columns that are not named are left alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
ADDED = ("number", "address", "name", "secret", "date", "mailbox")

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: The parts of an email; what a phone number or a number can consist of.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
PHONE_RUN = re.compile(r"\+[\x20().0-9-]*")
DIGIT_RUN = re.compile(r"[0-9][0-9.\x20-]*")

# Candidates wider than the base patterns; every quantifier is bounded or runs over one class, so scans are linear.
DIGITS = re.compile(r"[0-9][0-9.\x20-]*[0-9]")
GROUPED = re.compile(r"(?<![\w.+-])\(?[0-9]{2,19}\)?(?:[\x20.-][0-9]{2,5}){0,5}(?![\w-]|\.[0-9])")
DATE = re.compile(r"(?<![0-9./-])(?:[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2[0-9]{4})(?![0-9/-]|\.[0-9])")
SECRET = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
AT = re.compile(r"\(at\)|\[at\]|\x20at\x20")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{2,40}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{2,40}(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?)[A-Za-z0-9-]{2,40}){1,4}")
STREET = re.compile(r"\b[0-9]{1,5}\x20[A-ZÀ-Þ][\w'-]{1,30}(?:\x20[A-ZÀ-Þ][\w'-]{1,30}){1,2}|\b[A-ZÀ-Þ]\w{1,30}(?:straße|strasse|weg|platz|allee)\x20[0-9]{1,4}[a-z]?\b|\b(?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Cc]alle|[Aa]venida|[Pp]laza)(?:\x20(?:de|du|des|la|del|los)){0,2}\x20[A-ZÀ-Þ]\w{1,30}(?:,?\x20[0-9]{1,4}\b)?")
NAMED = re.compile(r"\b(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra)\.?\x20)?[A-ZÀ-Þ][a-zß-ÿ'-]{1,30}(?:\x20[A-ZÀ-Þ][a-zß-ÿ'-]{1,30}){0,2}")
WORDS = re.compile(r"[^\W\d_]+")

# The gazetteers. Words that announce a kind, words that announce other numbers, names, streets, and what
# begins with a capital but is no name.
CONTACT = "phone tel telephone call mobile cell fax contact email mail ssn passport iban account card telefon handy konto téléphone portable compte teléfono móvil cuenta correo reach dial whatsapp"
HIDDEN = "token key secret password passwd pwd apikey api auth bearer credential credentials access private passwort schlüssel kennwort geheim clé motdepasse clave contraseña"
BIRTH = "born birth birthday dob birthdate geboren geburtstag né née naissance nacido nacida nacimiento"
PEOPLE = "name named called mr mrs ms dr prof herr frau mme monsieur madame sr sra signed author dear regards sincerely heißt namens nom nommé appelle nombre llamado llama"
PLACE = "address street lives live road at adresse wohnt anschrift habite rue dirección vive calle ship deliver"
ANNOUNCE = tuple(frozenset(x.split()) for x in (CONTACT, PLACE, PEOPLE, HIDDEN, BIRTH, CONTACT))
OTHER = frozenset("version isbn issn chapter section figure table page year price total order invoice copyright license released under gnu public commons id no number release build commit sha md5 checksum hash revision doi part volume seite kapitel preis page chapitre prix página capítulo precio".split())
GIVEN = frozenset("james john robert michael william david richard joseph thomas charles daniel matthew mark paul steven andrew george peter mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy anna emma laura alice julia maria hans karl klaus jürgen wolfgang stefan andreas ursula sabine heike petra jean pierre michel jacques philippe nicolas marie nathalie isabelle sophie claire josé juan carlos luis miguel antonio francisco manuel carmen ana isabel lucía elena sofía".split())
WAYS = frozenset("street st road rd avenue ave lane ln drive dr boulevard blvd court ct square way terrace straße strasse weg platz allee rue boulevard calle avenida plaza".split())
ENDINGS = frozenset("com org net edu gov info io de fr es it uk eu ch at be nl".split())
COMMON = frozenset("the this that these those a an in on at of and but or if it is was we you they he she i my our your to for from with as by no not there here what when who how all some new der die das ein eine und oder aber wenn ist war wir sie ich in im am zu von mit auf für nicht le la les un une des et ou mais si il elle nous vous je de du en à dans sur pour avec el los las una y o pero es era nosotros ellos yo que no con por para monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december university company institute street license public general creative commons".split())

#: Kinds that are added, and from which base kinds their labelers learn too.
LIKE = {4: (2, 3), 5: (), 6: (), 7: (), 8: (), 9: (0,)}
LABELERS = 8
FEATURES = 12
#: What the features mean before anything is seen (log-odds, the intercept last): a vote each way, and that a bare shape is not enough.
MEANT = np.array([1.4, -1.4, 1.4, -1.4, 1.4, -1.4, 1.8, -1.8, 0.7, 0.0, 0.0, -0.7, -2.0])
ANNOUNCED, OTHERWISE, FAILS = 6, 7, 5
#: The share of a kind's candidates that are personal data is kept within.
SHARES = (0.05, 0.95)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans, by kind and start."""
    out: list[tuple[int, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:  # a match is what can be a local part before an at sign, and a domain after it
        lo = at
        while lo > end and LOCAL.match(text, lo - 1):
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((0, lo, m.end()))
        end = m.end() if m else at + 1
        at = text.find("@", end)
    ips, cards = [], []
    for run in DIGIT_RUN.finditer(text):
        lo, hi = run.span()
        if hi - lo < 7:
            continue
        piece = run[0]
        if piece.count(".") > 2:
            ips += [(1, m.start(), m.end()) for m in IP.finditer(text, lo, hi) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
        if hi - lo >= 13:
            for m in CARD.finditer(text, lo, hi):
                if m.end() - m.start() >= 13:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        cards.append((2, m.start(), m.end()))
    out += ips + cards
    at = text.find("+")
    while at >= 0:
        end = PHONE_RUN.match(text, at).end()
        m = PHONE.match(text, at, end)
        if m:
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, at, m.end()))
            end = m.end()
        at = text.find("+", max(at + 1, end if m else at + 1))
    return out


def looser(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates, as (kind, start, end) with kinds from 4 on, clear of ``base`` and of each other."""
    found = []
    for run in DIGITS.finditer(text):
        if run.end() - run.start() >= 5:
            lo, hi = max(0, run.start() - 2), min(len(text), run.end() + 2)
            found += [(4, m.start(), m.end()) for m in GROUPED.finditer(text, lo, hi) if sum(map(str.isdigit, m[0])) >= 5]
    if "at" in text:
        for at in AT.finditer(text):
            found += [(9, m.start(), m.end()) for m in SPELLED.finditer(text, max(0, at.start() - 48), min(len(text), at.end() + 128)) if m.start() <= at.start() < m.end()]
    found += [(5, m.start(), m.end()) for m in STREET.finditer(text)]
    for m in NAMED.finditer(text):
        words = m[0].split(" ")
        if len(words) > 1:
            found.append((6, m.start(), m.end()))
    for m in SECRET.finditer(text):
        digits = sum("0" <= c <= "9" for c in m[0])
        if 2 <= digits <= len(m[0]) - 2:
            found.append((7, m.start(), m.end()))
    found += [(8, m.start(), m.end()) for m in DATE.finditer(text)]
    out: list[tuple[int, int, int]] = []
    fixed, at, end = sorted((s, e) for _, s, e in base), 0, 0
    reach = 0  # where the base spans that begin before the candidate end
    # of candidates that begin at one place dates come first, then streets and secrets
    for k, s, e in sorted(set(found), key=lambda x: (x[1], (8, 5, 7, 9, 6, 4).index(x[0]), -x[2])):
        while at < len(fixed) and fixed[at][0] <= s:
            reach = max(reach, fixed[at][1])
            at += 1
        if s >= end and s >= reach and (at == len(fixed) or e <= fixed[at][0]):
            out.append((k, s, e))
            end = e
    return out


def entropy(piece: str) -> float:
    """Bits per character."""
    n = len(piece)
    return -sum(c / n * math.log2(c / n) for c in Counter(piece).values())


def describe(text: str, span: tuple[int, int, int], kind: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Votes (1 yes, -1 no, 0 nothing) of the labelers on a span as one of ``kind``, and the classifier's features (0 or 1)."""
    _, s, e = span
    piece = text[s:e]
    ascii_digits = "".join(c for c in piece if "0" <= c <= "9")
    digits = len(ascii_digits)
    before = [w.lower() for w in WORDS.findall(text[max(0, s - 40) : s])][-3:]
    after = [w.lower() for w in WORDS.findall(text[e : e + 24])][:2]
    own = [w.lower() for w in WORDS.findall(piece)]
    says = ANNOUNCE[kind - 4]
    announced, other = any(w in says for w in before) or kind == 6 and own[0] in says, any(w in OTHER for w in before) or any(w in OTHER for w in own)
    lead = text[max(0, s - 3) : s].rstrip()[-1:]
    assigned = lead in ("=", ":", '"', "'")
    starts = s == 0 or lead in (".", "!", "?", "\n", "|", "#") or "\n" in text[max(0, s - 2) : s]
    calendar = bool(re.fullmatch(r"(?:19|20)[0-9]{2}[\x20.-](?:19|20)?[0-9]{2}", piece))
    parts = [int(p) for p in re.split(r"[^0-9]+", piece) if p.isascii() and p.isdigit()][:4]
    if kind == 4:
        shape = 1 if 9 <= digits <= 19 else -1 if digits < 7 else 0
        listed = -1 if calendar else 0
    elif kind == 5:
        shape = 1 if digits else 0
        listed = 1 if any(w in WAYS or w.endswith(("straße", "strasse")) for w in own) else -1
    elif kind == 9:
        shape = 1 if "@" in piece or "(" in piece or "[" in piece or "dot" in own else -1
        listed = 1 if own and own[-1] in ENDINGS else -1
    elif kind == 6:
        shape = 1 if 2 <= len(own) <= 4 and all(len(w) > 1 for w in own) else -1
        listed = 1 if any(w in GIVEN for w in own) else -1 if any(w in COMMON for w in own) else 0
    elif kind == 7:
        shape = 1 if re.fullmatch(r"[0-9a-fA-F]{32,}", piece) or entropy(piece) >= 3.8 else -1 if entropy(piece) < 3 else 0
        listed = -1 if any(w in COMMON for w in own if len(w) > 3) else 0
    else:
        year, months = [p for p in parts if p > 31], [p for p in parts if p <= 12]
        shape = 1 if len(year) == 1 and months and 0 not in parts else -1
        listed = 1 if year and 1900 <= year[0] <= 2020 else -1
    sums = (1 if luhn(ascii_digits) else -1) if kind == 4 and 13 <= digits <= 19 else 0
    place = -1 if kind == 6 and starts and not announced else 1 if kind in (4, 7) and assigned else 0
    alone = -1 if text.count(piece, max(0, s - 2000), s + 2000) > 2 else 0
    votes = (shape, listed, sums, 1 if announced else 0, -1 if other else 0, 1 if any(w in says for w in after) else 0, place, alone)
    features = (shape > 0, shape < 0, listed > 0, listed < 0, sums > 0, sums < 0, announced, other, assigned, starts, len(piece) >= 24, alone < 0)
    return votes, tuple(map(int, features))


def expectation_maximisation(votes: np.ndarray, known: np.ndarray, counts: np.ndarray, rounds: int = 100, trust: float = 0.1, accuracy: float = 0.8) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each row, rates[class, labeler, vote], prior) of rows of votes with their counts; ``known`` is 1 for rows that are personal data, -1 for rows that aren't, 0 for the others.

    Votes are taken to be independent given the class. Every labeler's rates are pulled towards one that is right with
    probability ``accuracy`` when it votes, by ``trust`` times the votes there are, which keeps the classes from changing sides.
    """
    (n, m), known = votes.shape, np.asarray(known, int)
    onehot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    share = np.einsum("n,nmv->mv", counts, onehot) / max(1.0, counts.sum())
    spoken = share[:, 0] + share[:, 2]
    want = np.stack([np.stack([spoken * a, share[:, 1], spoken * (1 - a)], 1) for a in (accuracy, 1 - accuracy)])
    pull = trust * counts.sum() * want + 0.5
    rates, prior = want + 1e-3, 0.5
    post = np.full(n, 0.5)
    for _ in range(rounds):
        rates = rates / rates.sum(axis=2, keepdims=True)
        say = np.einsum("nmv,cmv->cn", onehot, np.log(rates))
        odds = say[1] - say[0] + np.log(prior / (1 - prior))
        new = np.where(known == 0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))), known > 0)
        done, post = np.abs(new - post).max(initial=0) < 1e-9, new
        w = np.stack([(1 - post) * counts, post * counts])
        prior = float(np.clip((w[1].sum() + 1) / (w.sum() + 2), *SHARES))
        rates = np.einsum("cn,nmv->cmv", w, onehot) + pull
        if done:
            break
    return post, rates / rates.sum(axis=2, keepdims=True), prior


def logistic(x: np.ndarray, p: np.ndarray, w: np.ndarray, centre: np.ndarray, ridge: float = 2.0, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic model of probabilities ``p`` with row weights, drawn to ``centre`` by ``ridge``, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    beta = centre.astype(float)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (w * (p - q)) - ridge * (beta - centre))
        size = np.abs(step).max()
        beta = beta + step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return beta


def is_known(base: bool, features: Sequence[int]) -> int:
    """1 for what a base pattern found, -1 for what is announced as something else, or fails its check digit, and isn't announced as the kind."""
    return 1 if base else -1 if not features[ANNOUNCED] and (features[OTHERWISE] or features[FAILS]) else 0


def fit(docs: DataFrame, text: str = "text") -> dict:
    """Kind -> rates and prior of the label model, weights of the span classifier. What reaches the driver is a row per pattern of votes and features, with its count."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                base = base_spans(t)
                for span in base + looser(t, base):
                    for kind in (span[0],) if span[0] > 3 else (k for k, like in LIKE.items() if span[0] in like):
                        v, f = describe(t, span, kind)
                        seen[",".join(map(str, (*v, *f, is_known(span[0] < 4, f), kind)))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    rows = docs.where(F.col(text).isNotNull()).select(text).mapInArrow(votes, "pattern string, n long")
    rows = rows.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    model = {}
    for kind in LIKE:
        own = [(list(map(int, r.pattern.split(","))), r.n) for r in rows if r.pattern.endswith(f",{kind}")]
        if all(x[-2] == 1 for x, _ in own):
            continue  # no candidate of this kind
        data, counts = np.array([x for x, _ in own]), np.array([n for _, n in own], float)
        known = data[:, -2]
        # known spans would drown the rest: those of base patterns weigh no more than all candidates together
        w = counts * np.where(known == 1, min(1.0, counts[known < 1].sum() / max(1.0, counts[known == 1].sum())), 1.0)
        post, rates, prior = expectation_maximisation(data[:, :LABELERS], known, w)
        weights = logistic(data[:, LABELERS:-2], post, w, MEANT)
        model[kind] = {"rates": rates.round(6).tolist(), "prior": round(prior, 6), "weights": weights.round(9).tolist()}
    return model


def find(text: str, weights: dict[int, list[float]], least: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans) of a text."""
    base, added, edge = base_spans(text), [], math.log(least / (1 - least))
    for span in looser(text, base):
        own = weights.get(span[0])
        if own and sum(w for w, f in zip(own, describe(text, span, span[0])[1], strict=False) if f) + own[-1] >= edge:
            added.append(span)
    return base, sorted(added)


def listed(spans: list[tuple[int, int, int]]) -> str:
    names = KINDS + ADDED
    return ",".join(f"{names[k]}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added) and n_added of every document."""
    weights = {kind: own["weights"] for kind, own in model.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                base, added = find(t.as_py() or "", weights, least)
                n = Counter(k for k, _, _ in base)
                rows.append((n[0], n[1], n[2], n[3], hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added), len(added)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [key, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"`{key}` long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(docs: DataFrame, model: dict, text: str = "text", least: float = 0.5, sized: str | None = "n_chars") -> DataFrame:
    """The documents with every span, base or added, replaced by its kind in angle brackets; ``sized`` gets the new length. A null text stays null."""
    at, names = docs.columns.index(text), KINDS + ADDED
    count = docs.columns.index(sized) if sized in docs.columns else None
    weights = {kind: own["weights"] for kind, own in model.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t in batch.column(at):
                t = t.as_py()
                if t:
                    base, added = find(t, weights, least)
                    out, end = [], 0
                    for s, e, k in sorted((s, e, k) for k, s, e in base + added):
                        if s >= end:
                            out += [t[end:s], f"<{names[k]}>"]
                        end = max(end, e)
                    t = "".join([*out, t[end:]]) if out else t
                texts.append(t)
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            if count is not None:
                cols[count] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
