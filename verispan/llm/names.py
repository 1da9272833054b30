"""Variant spellings of the names of persons and organisations within an affiliation.

Distinct spellings are reduced to forms (case, accents, order and nicknames resolved), so formatting
variants cost nothing further. Forms find each other by MinHash bands over the padded q-grams of
their name tokens, and by exact keys where one typo leaves few q-grams; candidates are verified
token by token (Monge-Elkan with rules for initials, nicknames and conflicting names) and grouped by
star clustering.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verispan.scale import attach, spread, written

ROWS = 2
SIMILAR = 0.4
"""Jaccard similarity of padded bigrams from which the bands find two spellings of one token; below it ``near_keys`` do."""
RECALL = 0.985
SPLIT = 256
"""A block of more forms is cut into parts of about so many; every pair of parts is a task of its own, so no pair is lost."""
LONG = 32
"""Tokens of so many letters are found by their ends, shorter ones by their deletions."""

# Short forms of given names, words of organisation names, their abbreviations, letters without a decomposition.
NICKNAMES = {
    "alexander": "alex alec sasha sandy xander", "alexandra": "lexi sandra", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "catherine": "cathy cath",
    "katherine": "kate kathy katie kit kitty kat", "charles": "charlie chuck chas", "christopher": "chris topher kit", "christine": "chrissy tina", "daniel": "dan danny", "david": "dave davey",
    "deborah": "deb debbie debby", "edward": "ed eddie ted ned", "elizabeth": "liz beth betty eliza lizzie betsy libby", "frederick": "fred freddie freddy", "gabriel": "gabe",
    "gregory": "greg", "harold": "harry hal", "henry": "hank", "ignatius": "iggy", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "john": "jack johnny",
    "jonathan": "jon", "joseph": "joe joey", "josephine": "jo josie", "joshua": "josh", "kenneth": "ken kenny", "lawrence": "larry", "leonard": "len lenny leo", "margaret": "maggie meg peggy marge greta rita",
    "matthew": "matt", "michael": "mike mick mickey misha", "nathaniel": "nate", "nicholas": "nick nico nicky", "oliver": "ollie", "patricia": "pat patty trish tricia", "patrick": "paddy",
    "peter": "pete", "philip": "phil", "rebecca": "becky", "richard": "rich rick dick ricky", "robert": "rob bob bobby robbie", "ronald": "ron", "samuel": "sam sammy", "samantha": "samantha",
    "stephen": "steve", "steven": "steve", "susan": "sue suzie susie", "theodore": "theo teddy", "thomas": "tom tommy", "timothy": "tim", "ursula": "ulla uschi", "victoria": "vicky tori vicki",
    "vincent": "vince", "walter": "walt", "william": "bill will billy willy liam", "zachary": "zach zack zak",
}
ORGANISATION = frozenset("institute institut collaboration consortium group university society network committee team study center centre initiative project association foundation hospital laboratory department agency council academy college school panel alliance programme program".split())
ABBREVIATIONS = {
    "wg": "working group", "inst": "institute", "cons": "consortium", "collab": "collaboration", "coll": "collaboration", "univ": "university", "dept": "department", "assoc": "association",
    "soc": "society", "lab": "laboratory", "grp": "group", "ctr": "center", "cent": "center", "centre": "center", "natl": "national", "intl": "international", "comm": "committee", "consort": "consortium", "hosp": "hospital",
}
SMALL_WORDS = frozenset("the a an of for and on in de des der und et".split())
LETTERS = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ð": "d", "þ": "th", "ı": "i"})
SHORT = {}
for _full, _forms in NICKNAMES.items():
    for _x in _forms.split():
        SHORT.setdefault(_x, set()).add(_full)


def plain(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.lower().translate(LETTERS))
    return "".join(c for c in text if not unicodedata.combining(c))


def form_of(family: str | None, given: str | None) -> tuple[str, tuple[str, ...], tuple[str, ...]] | None:
    """(kind, long tokens, initials) of a spelling; None without a family value. Kind is p, o or a (acronym)."""
    family, given = (family or "").strip(), (given or "").strip()
    if not family:
        return None
    words = re.findall(r"[^\W_]+", plain(family))
    if not given and len(words) > 1:
        full = " ".join(ABBREVIATIONS.get(w, w) for w in words).split()
        if ORGANISATION & set(full) and (len(full) > 2 or ORGANISATION & set(words)):
            return "o", tuple(sorted(w for w in full if w not in SMALL_WORDS)), ()
    if not given and re.fullmatch(r"[A-Z]{2,8}", family) and len(family) < 7:
        return "a", ("".join(sorted(family.lower())),), ()
    long, initials = [], []
    first, comma, rest = family.partition(",")
    doubled = first if given or comma else ""  # a double family name may lack its hyphen
    for part, other in ((doubled, given or rest), (rest if doubled else family, given), (given, family)):
        tokens = re.findall(r"[^\W_]+(?:[-'’‐][^\W_]+)*", part)
        if part and part is doubled and len(tokens) > 1 and all(len(t) > 2 for t in tokens):
            tokens = ["-".join(tokens)]
        for token in tokens:
            bare = re.sub(r"[-'’‐]", "", token)
            word = "-".join(plain(x) for x in re.split(r"[-‐]", re.sub(r"['’]", "", token)))
            pair = bare.isupper() and len(bare) == 2
            if len(word) == 1:
                initials.append(word)
            elif pair and ((part is given and not other.isupper()) or (part is not given and len(tokens) > 1) or (part is rest and comma)):
                initials += list(word.replace("-", ""))  # AS stands for A. S.
            else:
                long.append(word)
    if not long:
        long, initials = ["".join(initials)], []
    return "p", tuple(sorted(long)), tuple(sorted(initials))


def full_names(token: str) -> set[str]:
    return {token} | SHORT.get(token, set())


def distance(a: str, b: str, most: int) -> int:
    """Edits and swaps of neighbours between two tokens, ``most + 1`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def token_score(a: str, b: str) -> float:
    """Similarity of two long tokens: 1 equal, 0.97 nickname, by edits below, 0 for different tokens."""
    if a == b:
        return 1.0
    if full_names(a) & full_names(b):
        return 0.97
    if ("-" in a) != ("-" in b):  # one half of a double name
        whole, half = (a, b) if "-" in a else (b, a)
        if any(len(x) > 3 and distance(x, half, 1) <= 1 for x in whole.split("-")):
            return 0.9
    a, b = a.replace("-", ""), b.replace("-", "")
    if a == b:
        return 1.0
    n = min(len(a), len(b))
    if n < 4:
        return 0.0
    most = 1 if n < 9 else 2
    d = distance(a, b, most)
    if n == 4 and (d > 1 or sorted(a) != sorted(b) and len(a) == len(b)):
        return 0.0
    return 1 - d / (n + 2) if d <= most else 0.0


def organisation_score(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Symmetric Monge-Elkan over the words of two organisations; 0 if any word has no counterpart."""
    if len(a) != len(b):
        return 0.0
    total = 0.0
    for x, y in ((a, b), (b, a)):
        for t in x:
            best = max(token_score(t, u) for u in y)
            if best < 0.7:
                return 0.0
            total += best
    score = total / (2 * len(a))
    return score if score >= 0.94 else 0.0


def person_score(la: tuple[str, ...], ia: tuple[str, ...], lb: tuple[str, ...], ib: tuple[str, ...]) -> float:
    """Monge-Elkan over the tokens of two persons, 0 where tokens conflict.

    Long tokens pair off one to one; one long token more on a side must be abbreviated by an initial
    on the other; initials that are left over on both sides conflict.
    """
    if len(la) < len(lb):
        la, ia, lb, ib = lb, ib, la, ia
    free, scores, edits = list(lb), [], 0
    rest = []
    pairs = sorted(((token_score(x, y), x, y) for x in la for y in lb), reverse=True)
    used_a: list[str] = []
    for s, x, y in pairs:
        if s <= 0 or used_a.count(x) >= la.count(x) or y not in free:
            continue
        used_a.append(x)
        free.remove(y)
        scores.append(s)
        edits += 0 < s < 0.97
    if free or not scores or edits > 2:
        return 0.0
    rest = list(la)
    for x in used_a:
        rest.remove(x)
    left_b = list(ib)
    for x in rest:  # a name that the other side only gives as an initial
        letters = {n[0] for n in full_names(x)}
        hit = next((i for i in left_b if i in letters), None)
        if hit is None:
            return 0.0
        left_b.remove(hit)
        scores.append(0.9)
    left_a = list(ia)
    for i in list(left_a):
        if i in left_b:
            left_a.remove(i)
            left_b.remove(i)
            scores.append(1.0)
    if left_a and left_b:
        return 0.0
    known = len(scores)
    if known < 2:  # one token alone names nobody
        return 0.0
    return sum(scores) / known - 0.01 * (len(left_a) + len(left_b))


def bands_for(similar: float, rows: int, recall: float) -> int:
    """Bands needed so that a pair of the given similarity collides with the given probability: 1 - (1 - s^r)^b."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similar**rows))


def grams(token: str) -> np.ndarray:
    """The padded bigrams of a token as numbers."""
    t = "\x02" + token.replace("-", "") + "\x03"
    return np.array([ord(a) * 0x110000 + ord(b) for a, b in zip(t, t[1:])], np.uint64)


BANDS = bands_for(SIMILAR, ROWS, RECALL)
_SEEDS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(BANDS * ROWS)], np.uint64)


def band_keys(token: str) -> list[int]:
    """The MinHash bands of a token."""
    with np.errstate(over="ignore"):
        x = grams(token) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        h = x[None, :] * _SEEDS[:, None]
        h ^= h >> np.uint64(29)
        low = (h * np.uint64(0xBF58476D1CE4E5B9)).min(axis=1).reshape(BANDS, ROWS)
        key = low[:, 0] * np.uint64(0x9E3779B97F4A7C15) + low[:, 1] + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
    return [int(k) for k in key.view(np.int64)]


def near_keys(token: str) -> set[int]:
    """Keys that any two tokens share whose edits leave them less alike than ``SIMILAR``, whatever the bands do.

    Tokens one edit or swap apart share the text after at most one deletion, two apart after at most
    two; from 13 letters on two edits leave the bands enough. Both halves of a double name count as
    tokens of one edit. Of a long token one edit leaves the first or the last letters as they are.
    """
    bare = token.replace("-", "")
    texts = set()
    for t in {bare, *(x for x in token.split("-") if len(x) > 3)}:
        if 3 <= len(t) <= LONG + 1:
            once = {t, *(t[:i] + t[i + 1 :] for i in range(len(t)))}
            texts |= once
            if t == bare and 9 <= len(t) <= 14:
                texts |= {x[:i] + x[i + 1 :] for x in once for i in range(len(x))}
        if len(t) >= LONG:
            texts |= {"<" + t[:12], ">" + t[-12:]}
    return {xxhash.xxh64_intdigest(x) - (1 << 63) for x in texts}


FORM = "group_id string, spelling string, n long, form string, kind string, long array<string>, initials array<string>, acronym string"


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for g, family, given, n in zip(pdf["group_id"], pdf["family"], pdf["given"], pdf["n"]):
            f = form_of(family, given)
            if f is None:
                continue
            kind, long, initials = f
            canon = tuple(sorted(min(full_names(t)) if kind == "p" and len(SHORT.get(t, ())) == 1 else t for t in long))
            acronym = "".join(sorted(w[0] for w in long)) if kind == "o" else long[0] if kind == "a" else None
            rows.append((g, f"{family}|{given or ''}", n, f"{kind} {' '.join(canon)} {' '.join(initials)}", kind, list(canon), list(initials), acronym))
        yield pd.DataFrame(rows, columns=["group_id", "spelling", "n", "form", "kind", "long", "initials", "acronym"])


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each form under each band and near key of each of its tokens, together with an initial of another token and the group."""
    mask = (1 << 64) - 1

    def block(group: int, key: int, initial: str) -> int:
        return ((key * 0x9E3779B97F4A7C15 + xxhash.xxh64_intdigest(initial, group & mask)) & mask) - (1 << 63)

    for pdf in batches:
        ids: list[int] = []
        blocks: list[int] = []
        for id_, g, kind, long, initials, acronym in zip(pdf["id"], pdf["group_id"], pdf["kind"], pdf["long"], pdf["initials"], pdf["acronym"]):
            group, found = xxhash.xxh64_intdigest(g), set()
            if acronym is not None:
                found.add(block(group, 0, "=" + acronym))
            if kind == "o":
                found |= {block(group, k, "o") for k in band_keys(" ".join(long))}
            if kind == "p":
                for i, t in enumerate(long):
                    rest = {n[0] for j, x in enumerate(long) if j != i for n in full_names(x)} | set(initials)
                    if rest and len(t) > 1:
                        keys = {*band_keys(t), *near_keys(t)}
                        found |= {block(group, k, r) for k in keys for r in rest}
            blocks += found
            ids += [id_] * len(found)
        yield pd.DataFrame({"block": np.array(blocks, np.int64), "id": np.array(ids, np.int64)})


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        scores = []
        for a, b in zip(pdf["a"], pdf["b"]):
            (ka, la, ia), (kb, lb, ib) = ((x["kind"], tuple(x["long"]), tuple(x["initials"])) for x in (a, b))
            if ka == kb == "p":
                scores.append(person_score(la, ia, lb, ib))
            elif ka == kb == "o":
                scores.append(organisation_score(la, lb))
            else:
                scores.append(0.9 if {ka, kb} == {"a", "o"} else 0.0)
        yield pd.DataFrame({"u": pdf["u"], "v": pdf["v"], "score": scores})


def candidate_pairs(forms: DataFrame) -> DataFrame:
    """``u, v``: the distinct pairs of form ids (u < v) that share a block.

    A block of more than ``SPLIT`` forms is cut into parts; its pairs are the pairs of parts, each
    joined under a key of its own, so a block of any size is spread and loses nothing.
    """
    blocks = written(spread(forms.select("id", "group_id", "kind", "long", "initials", "acronym")).mapInPandas(_blocks, "block long, id long"), "name-blocks")
    large = blocks.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT)
    rows = attach(blocks, large, ["block"]).withColumn("parts", F.coalesce(F.ceil(F.col("n") / SPLIT), F.lit(1)).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    a = rows.select("block", F.col("id").alias("a"), F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"))
    b = rows.select("block", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), "part")).alias("i"), F.col("part").alias("j"))
    pairs = a.join(b, ["block", "i", "j"]).filter("a <> b and (i < j or a < b)")
    return pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def star_clusters(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``v, center`` for every vertex of ``edges`` (u, v, score, pu, pv, both directions).

    Vertices are taken by falling priority; one that is not adjacent to a center becomes a center.
    Each round settles all vertices without an unsettled neighbour of higher priority at once, which
    gives the same stars as one by one. A satellite joins its most similar center.
    """
    key = ["v"]
    open_edges, centers = edges, None
    for _ in range(most_rounds):
        state = open_edges.groupBy(*key).agg(F.max("pv").alias("own"), F.max("pu").alias("best"))
        new = written(state.filter("own > best").select(*key), "star-centers")
        if new.isEmpty():
            break
        centers = new if centers is None else centers.unionByName(new)
        hit = open_edges.join(new.select(F.col("v").alias("u")), ["u"], "left_semi").select(*key).distinct()
        gone = new.unionByName(hit)
        left = open_edges.join(gone, key, "left_anti").join(gone.select(F.col("v").alias("u")), ["u"], "left_anti")
        # a vertex whose open neighbours are all settled otherwise is a center of its own
        alone = open_edges.select(*key, F.col("pv")).distinct().join(gone, key, "left_anti").join(left.select(*key).distinct(), key, "left_anti")
        centers = centers.unionByName(written(alone.select(*key), "star-alone"))
        open_edges = written(left, "star-edges")
    else:
        raise RuntimeError("star clustering did not end")
    if centers is None:
        return edges.select(*key, F.col("v").alias("center"))
    to = edges.join(centers.select(F.col("v").alias("u")), ["u"], "left_semi")
    joined = to.join(centers, key, "left_anti").groupBy(*key).agg(F.max(F.struct("score", "pu", "u")).alias("best")).select(*key, F.col("best.u").alias("center"))
    return joined.unionByName(centers.select(*key, F.col("v").alias("center")))


def name_forms(df: DataFrame, group: str, family: str, given: str) -> tuple[DataFrame, DataFrame]:
    """(spellings, forms): distinct spellings with their form, and distinct forms with an ``id``."""
    rows = df.select(F.col(group).cast("string").alias("group_id"), F.col(family).alias("family"), F.coalesce(F.col(given), F.lit("")).alias("given"))
    rows = rows.filter(F.col("group_id").isNotNull() & (F.trim("family") != "")).groupBy("group_id", "family", "given").agg(F.count("*").alias("n"))
    spellings = written(rows.mapInPandas(_forms, FORM), "spellings")
    forms = spellings.groupBy("group_id", "form").agg(
        F.sum("n").alias("n"), F.min("kind").alias("kind"), F.first("long").alias("long"), F.first("initials").alias("initials"), F.min("acronym").alias("acronym")
    )
    return spellings, written(forms.withColumn("id", F.monotonically_increasing_id()), "forms")


def name_entities(df: DataFrame, group: str = "affiliation_id", family: str = "family", given: str = "given") -> DataFrame:
    """``group_id, entity, spelling, n``: each distinct spelling (``family|given`` as stored) with its entity.

    Defined cases: rows without a group or a family value are left out; a null given name counts as
    empty; equal spellings are one with their count; a spelling without a counterpart is an entity
    of its own; very long names are compared whole; an empty table gives an empty result.
    """
    spellings, forms = name_forms(df, group, family, given)
    info = forms.select("id", "group_id", F.struct("kind", "long", "initials").alias("f"), F.struct(F.size("long").alias("full"), "n", (F.length("form")).alias("chars"), "form").alias("p"))
    side = lambda x, f: info.select(F.col("id").alias(x), F.col("group_id").alias(f"group_{x}"), F.col("f").alias(f))
    pairs = candidate_pairs(forms).join(side("u", "a"), "u").join(side("v", "b"), "v").filter("group_u = group_v")
    scored = pairs.select("u", "v", "a", "b").mapInPandas(_verify, "u long, v long, score double").filter("score >= 0.85")
    p = info.select("id", "p")
    half = scored.join(p.select(F.col("id").alias("u"), F.col("p").alias("pu")), "u").join(p.select(F.col("id").alias("v"), F.col("p").alias("pv")), "v")
    half = written(half.select("u", "v", "score", "pu", "pv"), "name-pairs")
    edges = written(half.unionByName(half.select(F.col("v").alias("u"), F.col("u").alias("v"), "score", F.col("pv").alias("pu"), F.col("pu").alias("pv"))), "name-edges")
    stars = star_clusters(edges)
    # centers by name: each form with the form of its center
    named = forms.select("group_id", "form", "id").join(stars.withColumnRenamed("v", "id"), "id", "left")
    centers = forms.select(F.col("id").alias("center"), F.col("form").alias("entity"))
    named = named.join(centers, "center", "left").select("group_id", "form", F.coalesce("entity", "form").alias("entity"))
    return attach(spellings, named, ["group_id", "form"]).select("group_id", "entity", "spelling", "n")


def spelling_pairs(entities: DataFrame) -> DataFrame:
    """All pairs of different spellings of an entity, the smaller in byte order first."""
    a = entities.select("group_id", "entity", F.col("spelling").alias("spelling_a"))
    b = entities.select("group_id", "entity", F.col("spelling").alias("spelling_b"))
    return a.join(b, ["group_id", "entity"]).filter("spelling_a < spelling_b").select("group_id", "spelling_a", "spelling_b")
