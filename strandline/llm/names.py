"""Variant spellings of the names of people and organisations.

A name is parsed into an anchor (family name, place) and other tokens (given name or
initial; kind of body and field, or their initials). Different names with the same tokens are one
signature. A symmetric-delete index on anchors (each anchor with every one-letter
deletion of it) brings together those at most one edit apart; the other tokens are
aligned by an optimal assignment that permits initials, abbreviations and nicknames.
Signatures with a full name are joined into components within their family; those that
say less (no given name, an initial only, no family) are attached where just one
component fits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from strandline.llm.pii_table import GIVEN
from strandline.operators.components import connected_components
from strandline.operators.lineage import durable
from strandline.operators.rows import once

# Nicknames of given names.
NICKNAMES = {
    "alexandra": "alex sandra sascha lexi", "benedikt": "ben bene", "benjamin": "ben benny", "bertram": "bert", "catherine": "cathy kate katie cath", "christine": "chris tina", "christopher": "chris",
    "cornelius": "niels cornel", "daniel": "dan danny", "david": "dave", "dominic": "nick dom", "dorothea": "doro thea dora dorothee", "edward": "ed ned ted eddie teddy", "eleonore": "ellie nora elly leonore",
    "elisabeth": "lisa liz elsa betty", "ferdinand": "ferdi nando", "frederick": "fred freddie", "frederike": "freddie rike fritzi", "gabriele": "gabi gaby", "gregory": "greg", "heinrich": "heiner heinz henry",
    "henrietta": "etta hettie henni", "ignatius": "iggy nate", "isabella": "bella isa", "james": "jim jimmy", "johannes": "hannes jo johann", "john": "jack johnny", "joseph": "joe", "josephine": "josie fine jo",
    "katharina": "kathi trina kate katja", "konstantin": "kostja konni", "leonhard": "leo leon", "ludmila": "mila luda", "margaret": "maggie peggy meg", "maximilian": "max", "michael": "mike", "natalia": "talia nata nat",
    "nathaniel": "nate nat", "nicholas": "nick", "oliver": "ollie olli", "ottilie": "tilly otti", "patricia": "pat trish patty", "philippa": "pippa", "rebecca": "becky becca", "richard": "dick rick ricky rich",
    "robert": "bob rob bobby", "samuel": "sam", "sebastian": "bastian basti seb", "stephen": "steve", "susanna": "susi sanne sue", "theodore": "ted teddy theo", "theresa": "tess resi", "thomas": "tom",
    "thomasina": "tamsin tommie", "ulrike": "ulli rike uli", "valentina": "tina vale", "wilhelmina": "minna willa mina", "william": "bill will willy",
}
# Kinds of bodies with their usual abbreviations, words of their fields, words that say nothing.
BODIES = {
    "agency": "ag", "association": "assoc assn", "board": "bd", "bureau": "bur", "centre": "ctr center", "college": "coll", "commission": "comm", "committee": "cttee", "council": "cncl", "department": "dept",
    "foundation": "fdn found", "institute": "inst", "laboratory": "lab", "ministry": "min", "observatory": "obs", "office": "off", "society": "soc", "university": "univ",
}
FIELDS = "archives climate culture data education energy finance fisheries forestry harbour health history labour levels maritime market pricing public records research river rivers safety science soil statistics surveys tidal trade transport water weather".split()
EMPTY = {"the", "of", "for", "f", "and", "de", "la", "le", "du", "des", "von", "van", "der", "a"}
TITLES = {"dr", "mr", "mrs", "ms", "prof", "herr", "frau", "miss", "sir", "agent", "bot", "mme", "jr", "sr"}
_DATE = re.compile(r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\d{1,4}$|[\s_\-](?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]{0,6}\.?[\s_\-]?\d{1,4}$")
#: Letters of a token beyond which it is indexed by its halves instead of by every deletion.
LONGEST = 40
#: Anchors under so many letters are the same only if they are equal: Li and Lu are two families.
LEAST_ANCHOR = 5
#: Words: parts of camel case in Latin letters, and runs of letters of other scripts.
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[A-Z]|[^\W\d_A-Za-z]+")
# Letters that don't come apart in normal form.
_WHOLE = str.maketrans({"ß": "ss", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "ı": "i"})


def folded(text: str) -> str:
    """Without accents, in normal form."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).translate(_WHOLE)


@lru_cache(maxsize=200_000)
def edits(a: str, b: str) -> int:
    """Optimal string alignment distance: insert, delete, replace, swap neighbours; 3 if it is more than 2."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > 2:
        return 3
    # Only cells within two of the diagonal can hold 2 or less.
    two, one = {}, {j: j for j in range(min(m, 2) + 1)}
    for i, x in enumerate(a, 1):
        now = {0: i} if i <= 2 else {}
        for j in range(max(1, i - 2), min(m, i + 2) + 1):
            d = min(one.get(j, 3) + 1, now.get(j - 1, 3) + 1, one.get(j - 1, 3) + (x != b[j - 1]))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, two.get(j - 2, 3) + 1)
            now[j] = d
        two, one = one, now
    return min(one.get(m, 3), 3)


def deletions(token: str) -> list[str]:
    """The token and every form of it with one letter less: two tokens one edit apart share one of them.

    A long token gives its halves instead: one edit leaves one half of the longer token whole, at the beginning or the end
    of both, so they share one as well, and work is linear in the token.
    """
    n = len(token)
    if n <= LONGEST:
        return sorted({token, *(token[:i] + token[i + 1 :] for i in range(n))})
    out = set() if n > LONGEST + 1 else set(deletions(token[:-1])) | {token[:i] + token[i + 1 :] for i in range(n)}
    for whole in (n - 1, n, n + 1):
        half = (whole - 2) // 2
        out |= {f"\x1a{half}:{xxhash.xxh3_64_hexdigest(token[:half])}", f"\x1b{half}:{xxhash.xxh3_64_hexdigest(token[n - half :])}"}
    return sorted(out)


@lru_cache(maxsize=1)
def _lexicon() -> tuple[dict[str, frozenset], dict[str, set], dict[str, str], dict[str, set]]:
    given: dict[str, set] = {x.lower(): {x.lower()} for x in GIVEN}
    for full, nicks in NICKNAMES.items():
        given.setdefault(full, set()).add(full)
        for nick in nicks.split():
            given.setdefault(nick, set()).add(full)
    near: dict[str, set] = {}
    for word in given:
        for d in deletions(word):
            near.setdefault(d, set()).add(word)
    words = {x: x for x in FIELDS}
    for full, short in BODIES.items():
        words[full] = full
        for s in short.split():
            words[s] = full
    near_words: dict[str, set] = {}
    for word in words:
        if len(word) > 3:
            for d in deletions(word):
                near_words.setdefault(d, set()).add(word)
    return {k: frozenset(v) for k, v in given.items()}, near, words, near_words


@lru_cache(maxsize=200_000)
def full_forms(token: str) -> frozenset:
    """The given names that a token can stand for; none if it is no given name, misspelt or short."""
    given, near, _, _ = _lexicon()
    if token in given:
        return given[token]
    if len(token) < 4:
        return frozenset()
    hits = {w for d in deletions(token) for w in near.get(d, ()) if len(w) > 3 and edits(token, w) <= 1}
    return frozenset().union(*(given[w] for w in hits)) if hits else frozenset()


@lru_cache(maxsize=200_000)
def body_word(token: str, dotted: bool) -> str | None:
    """The word of a body's name that a token is, misspelt or shortened (a dotted token may be any beginning)."""
    _, _, words, near = _lexicon()
    if token in words:
        return words[token]
    if dotted and len(token) >= 3:
        begun = [w for w in (*FIELDS, *BODIES) if w.startswith(token)]
        if len(begun) >= 1:
            return min(begun, key=len)
    if len(token) >= 4:
        hits = sorted(w for d in deletions(token) for w in near.get(d, ()) if edits(token, w) <= 1)
        if hits:
            return words[hits[0]]
    return None


def parse(name: str | None) -> list[tuple[str, str, tuple[str, ...]]]:
    """(kind, anchor, other tokens) for each way to read a name; kind p for people, o for bodies. Empty if there is nothing to read."""
    text = folded(name or "").strip()
    text = re.sub(r"(?<=[a-z0-9])[Aa]gent$|(?<=\d)[Bb]ot$", "", text)
    text = _DATE.sub("", text).strip()
    acronym = re.fullmatch(r"([A-Za-z][a-z]{3,})(?:-([a-z]{3,4})|([A-Z]{3,4}))", text)
    if acronym and (acronym[3] or acronym[2]):
        return [("o", acronym[1].lower(), tuple((acronym[2] or acronym[3]).lower()))]
    comma = "," in text
    parts, dotted = [], []
    for m in _PARTS.finditer(re.sub(r"(?<=[A-Z])(?=[A-Z][a-z])", " ", text) if not text.isupper() else text):
        word = m[0].lower()
        parts.append(word)
        dotted.append(m.string[m.end() : m.end() + 1] == ".")
    known = [body_word(w, d) if w not in EMPTY and len(w) > 2 else None for w, d in zip(parts, dotted)]
    if any(k in BODIES for k in known) and len(parts) > 1:
        rest = [w for w, k in zip(parts, known) if k is None and w not in EMPTY and len(w) > 1]
        words = [k for k in known if k is not None]
        if rest:
            anchor = max(rest, key=len)
            return [("o", anchor, tuple(sorted(words + [w for w in rest if w != anchor])))]
        if words:
            return [("o", words[0], tuple(sorted(words[1:])))]
    tokens = [w for w in parts if w not in TITLES]
    letters, long = [w for w in tokens if len(w) == 1], [w for w in tokens if len(w) > 1]
    if not long:
        return [("p", "".join(letters), ())] if letters else []
    if len(long) == 1:
        word = long[0]
        if letters:
            return [("p", word, (letters[0],))]
        readings = [("p", word, ())]
        if text.islower() and len(word) > 4:
            readings.append(("p", word[1:], (word[0],)))
        return readings
    # Which of two or more words is the given name: the lexicon says, else their order.
    given = [i for i, w in enumerate(long) if full_forms(w)]
    exact = [i for i in given if long[i] in _lexicon()[0]]
    if len(given) > 1:
        given = exact or given
    first = 1 if comma else 0
    g = first if first in given or not given else given[0]
    others = [w for i, w in enumerate(long) if i != g and w not in EMPTY]
    if not others:
        return [("p", long[g], ())]
    return [("p", others[-1] if not comma else others[0], (long[g],))]


def token_cost(a: str, b: str) -> float:
    """What it costs to take two tokens for one: 0 equal, 0.1 short for, 1 an edit, infinite if they differ."""
    if a == b:
        return 0.0
    if len(a) == 1 or len(b) == 1:
        short, other = (a, b) if len(a) == 1 else (b, a)
        return 0.1 if other[0] == short or any(x[0] == short for x in full_forms(other)) else float("inf")
    if full_forms(a) & full_forms(b):
        return 0.1 if edits(a, b) > 1 else 1.0
    if len(min(a, b, key=len)) >= 3 and (a.startswith(b) or b.startswith(a)):
        return 0.1
    return 1.0 if edits(a, b) <= 1 and len(a) > 3 else float("inf")


def alignment(a: tuple[str, ...], b: tuple[str, ...], unmatched: float) -> float:
    """The least cost of assigning the tokens of the shorter list to different ones of the longer; unmatched: of each that is left."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return unmatched * len(b)
    cost = np.array([[token_cost(x, y) for y in b] for x in a])
    best = assigned(np.where(np.isinf(cost), _NEVER, cost))
    return (best if best < _NEVER else float("inf")) + unmatched * (len(b) - len(a))


#: More than any assignment can cost.
_NEVER = 1e9


def assigned(cost: np.ndarray) -> float:
    """The least sum of costs of giving each row a column of its own, by shortest augmenting paths; no more rows than columns."""
    rows, columns = cost.shape
    if rows == 1:
        return float(cost.min())
    # Column 0 stands for none yet.
    row_potential, potential, owner = np.zeros(rows + 1), np.zeros(columns + 1), np.zeros(columns + 1, np.int64)
    for i in range(1, rows + 1):
        owner[0], at = i, 0
        least, before, done = np.full(columns + 1, np.inf), np.zeros(columns + 1, np.int64), np.zeros(columns + 1, bool)
        while True:
            done[at] = True
            here = owner[at]
            reduced = cost[here - 1] - row_potential[here] - potential[1:]
            nearer = ~done[1:] & (reduced < least[1:])
            least[1:][nearer], before[1:][nearer] = reduced[nearer], at
            following = int(np.where(done, np.inf, least).argmin())
            step = least[following]
            row_potential[owner[done]] += step
            potential[done] -= step
            least[~done] -= step
            at = following
            if not owner[at]:
                break
        while at:
            owner[at] = owner[before[at]]
            at = int(before[at])
    held = np.flatnonzero(owner[1:])
    return float(cost[owner[1:][held] - 1, held].sum())


def same_entity(kind: str, anchor_a: str, rest_a: tuple[str, ...], anchor_b: str, rest_b: tuple[str, ...]) -> float:
    """Cost of taking two readings for one entity; infinite if they can't be."""
    apart = edits(anchor_a, anchor_b)
    if apart > 1 or (apart == 1 and min(len(anchor_a), len(anchor_b)) < LEAST_ANCHOR):
        return float("inf")
    if kind == "p":
        return apart + (alignment(rest_a, rest_b, 0.0) if rest_a and rest_b else 0.3)
    # A body's kind and field must all be there.
    return apart + alignment(rest_a, rest_b, 10.0)


def link_names(df: DataFrame, *, key: str, name: str, family: str, families: str | None = None) -> DataFrame:
    """(id, entity): the entity of each row with a name; entity is the least id of its group.

    family: where a writer works; names in different ones are different entities. Where it is null,
    the first family of ``families`` (``family:n;...``) counts; where that is null too, the name is attached
    if what it fits lies in just one family. Rows with a null or empty name, or one without letters, are entities of
    their own; repeated rows count once; other columns are ignored; an empty table gives no
    rows.
    """
    fam = F.nullif(F.trim(F.col(family)), F.lit(""))
    if families is not None:
        fam = F.coalesce(fam, F.nullif(F.regexp_extract(F.coalesce(F.col(families), F.lit("")), r"^([^:;]+)", 1), F.lit("")))
    rows = once(df, key, {"name": F.coalesce(F.col(name), F.lit("")), "fam": fam}).select(F.col(key).cast("string").alias("id"), "name", "fam")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            taken, out = [], []
            for row, value in enumerate(part.column(1).to_pylist()):
                for kind, anchor, rest in parse(value):
                    taken.append(row)
                    out.append((kind, anchor, " ".join(rest)))
            rows_taken = pa.array(taken, pa.int64())
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([part.column(0).take(rows_taken), part.column(2).take(rows_taken), *[pa.array(c, pa.string()) for c in columns]], names=["id", "fam", "kind", "anchor", "rest"])

    readings = durable(rows.mapInArrow(read, "id string, fam string, kind string, anchor string, rest string"))
    # A signature is all that names of one reading have in common.
    sig = F.concat_ws("\x1f", F.coalesce("fam", F.lit("\x1e")), "kind", "anchor", "rest")
    signatures = readings.withColumn("sig", sig).groupBy("sig", "fam", "kind", "anchor", "rest").agg(F.count(F.lit(1)).alias("n"))
    # Strong: a full name in a known family. A reading of an all-small single word is weak either way.
    strong = F.col("fam").isNotNull() & ((F.col("kind") == "o") | (F.length("rest") > 1))
    signatures = durable(signatures.withColumn("strong", strong))

    # Symmetric-delete index on the different anchors.
    anchors = signatures.select("kind", "anchor").distinct()

    def delete(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            taken, keys = [], []
            for row, value in enumerate(part.column(1).to_pylist()):
                forms = deletions(value) if len(value) >= LEAST_ANCHOR else [value]
                taken += [row] * len(forms)
                keys += forms
            t = pa.array(taken, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(t), part.column(1).take(t), pa.array(keys, pa.string())], names=["kind", "anchor", "form"])

    forms = anchors.mapInArrow(delete, "kind string, anchor string, form string")
    near = (
        forms.alias("x").join(forms.alias("y"), ["kind", "form"])
        .select("kind", F.col("x.anchor").alias("anchor_a"), F.col("y.anchor").alias("anchor_b")).distinct()
        .where((F.col("anchor_a") == F.col("anchor_b")) | (F.levenshtein("anchor_a", "anchor_b", 2) >= 0))
    )
    near = durable(near)

    a = signatures.select(*[F.col(c).alias(f"{c}_a") for c in ("sig", "fam", "anchor", "rest", "strong")], "kind")
    b = signatures.select(*[F.col(c).alias(f"{c}_b") for c in ("sig", "fam", "anchor", "rest", "strong")], "kind")
    a_near = a.join(near, ["kind", "anchor_a"])

    def costed(pairs: DataFrame) -> DataFrame:
        def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                c = [x.to_pylist() for x in part.columns]
                cost = [same_entity(k, p, tuple(q.split()), r, tuple(s.split())) for k, p, q, r, s in zip(*c[2:7])]
                keep = [i for i, x in enumerate(cost) if x <= 2.5]
                t = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(t), part.column(1).take(t), pa.array([cost[i] for i in keep], pa.float64())], names=["sig_a", "sig_b", "cost"])

        return pairs.select("sig_a", "sig_b", "kind", "anchor_a", "rest_a", "anchor_b", "rest_b").mapInArrow(score, "sig_a string, sig_b string, cost double")

    # Within a family, strong with strong.
    inside = a_near.where("strong_a").join(b.where("strong_b").withColumnRenamed("fam_b", "fam_a"), ["kind", "anchor_b", "fam_a"]).where("sig_a < sig_b")
    strong_links = costed(inside)  # cut off in connected_components
    components = connected_components(strong_links, "sig_a", "sig_b")
    settled = durable(
        signatures.where("strong").select("sig").join(components.withColumnRenamed("node", "sig"), "sig", "left").select("sig", F.coalesce("component", "sig").alias("entity"))
    )

    # Weak to strong: in the family, or in any where there is none. Of the nearest entities there must be just one.
    weak = a_near.where("NOT strong_a")
    at_home = weak.where(F.col("fam_a").isNotNull()).join(b.where("strong_b").withColumnRenamed("fam_b", "fam_a"), ["kind", "anchor_b", "fam_a"])
    anywhere = weak.where(F.col("fam_a").isNull()).join(b.where("strong_b").drop("fam_b"), ["kind", "anchor_b"])
    columns = ["sig_a", "sig_b", "kind", "anchor_a", "rest_a", "anchor_b", "rest_b"]
    fits = costed(at_home.select(*columns).unionByName(anywhere.select(*columns))).join(settled.withColumnRenamed("sig", "sig_b"), "sig_b")
    per_id = readings.withColumn("sig_a", sig).select("id", "sig_a")
    options = durable(per_id.join(fits, "sig_a").groupBy("id", "entity").agg(F.min("cost").alias("cost")))
    nearest = options.withColumn("least", F.min("cost").over(Window.partitionBy("id"))).where(F.floor("cost") == F.floor("least"))
    attached = nearest.groupBy("id").agg(F.min("entity").alias("entity"), F.count(F.lit(1)).alias("n")).where("n = 1").select("id", "entity")
    strong_rows = per_id.join(settled.withColumnRenamed("sig", "sig_a"), "sig_a").groupBy("id").agg(F.min("entity").alias("entity"))
    placed = durable(strong_rows.unionByName(attached.join(strong_rows, "id", "left_anti")))

    # What fits no strong entity: weak names with one another, in their family; those of none with what fits them in one family at most.
    options_of = options.select("id").distinct()
    loose = durable(per_id.join(options_of, "id", "left_anti").join(placed.select("id"), "id", "left_anti"))
    loose_sigs = loose.select("sig_a").distinct()
    left = a_near.join(loose_sigs, "sig_a").where("NOT strong_a")
    right = b.where("NOT strong_b").join(loose_sigs.withColumnRenamed("sig_a", "sig_b"), "sig_b")
    met = durable(left.join(right, ["kind", "anchor_b"]).where("sig_a <> sig_b AND (fam_a = fam_b OR fam_a IS NULL OR fam_b IS NULL)"))
    loose_costs = costed(met).join(met.select("sig_a", "sig_b", "fam_a", "fam_b"), ["sig_a", "sig_b"])
    loose_costs = durable(loose_costs.where("cost < 1 OR (cost < 1.35 AND fam_a = fam_b)"))
    torn = loose_costs.where("fam_a IS NULL").groupBy("sig_a").agg(F.countDistinct("fam_b").alias("n")).where("n > 1").select("sig_a")
    loose_links = loose_costs.join(torn, "sig_a", "left_anti").join(torn.withColumnRenamed("sig_a", "sig_b"), "sig_b", "left_anti")
    linked_ids = loose.alias("l").join(loose_links.alias("k"), F.col("l.sig_a") == F.col("k.sig_a")).select(F.col("l.id").alias("id"), F.col("k.sig_b").alias("other"))
    by_sig = loose.groupBy("sig_a").agg(F.min("id").alias("head"))
    edges = loose.join(by_sig, "sig_a").select("id", "head").unionByName(
        linked_ids.join(by_sig.withColumnRenamed("sig_a", "other"), "other").select("id", "head")
    )
    loose_components = connected_components(edges, "id", "head").select(F.col("node").alias("id"), F.concat(F.lit("\x1d"), "component").alias("entity"))

    grouped = placed.unionByName(loose_components)
    every = durable(rows.select("id").join(grouped, "id", "left").select("id", F.coalesce("entity", F.concat(F.lit("\x1c"), "id")).alias("e")))
    heads = every.groupBy("e").agg(F.min("id").alias("entity"))
    return durable(every.join(heads, "e").select("id", "entity"))


def entity_pairs(linked: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs within each entity."""
    x, y = linked.alias("x"), linked.alias("y")
    return x.join(y, F.col("x.entity") == F.col("y.entity")).where(F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
