"""Name variants: token rules, collision curve, star clustering against brute force, edge cases."""

import itertools
import random

import pytest

from verispan.llm import names


def score(a, b):
    (ka, la, ia), (kb, lb, ib) = names.form_of(*a), names.form_of(*b)
    if ka == kb == "p":
        return names.person_score(la, ia, lb, ib)
    return names.organisation_score(la, lb) if ka == kb else 0.0


SAME = [
    (("Moostova", "Asel"), ("MOOSTOVA", "A.")), (("Moostova", "Asel"), ("Asel", "Moostova")), (("Moostova, A.", ""), ("Moostova A", "")), (("Lunkasewa", "Ingrid"), ("Lunkaséwa", "I")),
    (("Felcörewa", "Thomas"), ("Feclörewa", "Tom")), (("Zoë S. Jortédal", ""), ("Jortédal", "Zoë S.")), (("Brefelenko", "JM"), ("Brefelenko", "Joachim M.")), (("Teethoux Ornides", "Josephine"), ("Teethoux-Ornides", "Josie")),
    (("Working Group for Assay Standards, Quarrystone", ""), ("Quarrystone Assay Standards WG", "")), (("The Northmere Tidal Genomics Collaboration", ""), ("Notrhmere Tidal Genomics Collab.", "")),
]
DIFFERENT = [
    (("Moostova", "Asel"), ("Moostova", "Ingrid")), (("Umbtamenko", "Asel"), ("Umbtamenku", "Harold")), (("Quaystova", "Alexander D."), ("Quaystova", "Alexander K.")), (("Vonarenko", "Christopher"), ("Inglysberg", "Christopher")),
    (("Northmere Tidal Genomics Institute", ""), ("Northmere Cell Atlas Institute", "")), (("Brefelenko", "K."), ("Brefelenko", "Joachim M.")), (("Lee", "A"), ("Lea", "A")),
]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    assert score(a, b) >= 0.85 and score(b, a) == score(a, b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different(a, b):
    assert score(a, b) == score(b, a) == 0.0


def test_collision_curve():
    rnd = random.Random(1)
    hits = n = 0
    for _ in range(300):
        t = "".join(rnd.choice("abcdefghiklmnoprstuvwz") for _ in range(rnd.randint(6, 10)))
        i = rnd.randrange(len(t) - 1)
        u = t[:i] + t[i + 1] + t[i] + t[i + 2 :]
        a, b = set(names.grams(t).tolist()), set(names.grams(u).tolist())
        if t != u and len(a & b) / len(a | b) >= names.SIMILAR:
            n += 1
            hits += bool(set(names.band_keys(t)) & set(names.band_keys(u)))
    assert n > 50 and hits / n >= names.RECALL - 0.03


def alter(rnd, t):
    i = rnd.randrange(len(t) - 1)
    kind = rnd.randrange(4)
    x = rnd.choice("abcdefghiklmnoprstuvwz")
    return (t[:i] + t[i + 1] + t[i] + t[i + 2 :], t[:i] + x + t[i + 1 :], t[:i] + t[i + 1 :], t[:i] + x + t[i:])[kind]


def accepted_pairs():
    """Pairs of tokens that token_score accepts, by edits and by one half of a double name, with their similarity."""
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefghiklmnoprstuvwz") for _ in range(n))
    for _ in range(6000):
        t = word(rnd.randint(4, 15))
        u = alter(rnd, t)
        if len(t) > 8 and rnd.random() < 0.7:
            u = alter(rnd, u)
        yield t, u
        whole = f"{word(rnd.randint(4, 40))}-{t}"
        yield whole, rnd.choice([t, alter(rnd, t)])


def test_every_accepted_pair_below_the_bands_meets():
    low = found = 0
    for t, u in accepted_pairs():
        a, b = set(names.grams(t).tolist()), set(names.grams(u).tolist())
        if t != u and names.token_score(t, u) > 0 and len(a & b) / len(a | b) < names.SIMILAR:
            low += 1
            found += bool((set(names.band_keys(t)) | names.near_keys(t)) & (set(names.band_keys(u)) | names.near_keys(u)))
    assert low > 1000 and found == low
    long = "".join(random.Random(4).choice("abcdefgh") for _ in range(5_000))
    assert len(names.near_keys(long)) == 2 and names.near_keys(long) & names.near_keys(long[:70] + long[71:]) and names.near_keys("李") == set()


def test_star_clusters_against_brute_force(spark):
    rnd = random.Random(2)
    names_ = [f"v{i:02d}" for i in range(40)]
    pairs = [(a, b, round(rnd.random(), 3)) for a, b in itertools.combinations(names_, 2) if rnd.random() < 0.08]
    rows = [(a, b, s, a, b) for a, b, s in pairs] + [(b, a, s, b, a) for a, b, s in pairs]
    df = spark.createDataFrame(rows, "u string, v string, score double, pu string, pv string")
    near = {}
    for a, b, s in pairs:
        near.setdefault(a, {})[b] = s
        near.setdefault(b, {})[a] = s
    centers = []
    for v in sorted(near, reverse=True):
        if not any(c in near[v] for c in centers):
            centers.append(v)
    want = {v: v if v in centers else max((s, u) for u, s in near[v].items() if u in centers)[1] for v in near}
    assert {r.v: r.center for r in names.star_clusters(df).collect()} == want
    assert names.star_clusters(df.limit(0)).collect() == []


@pytest.mark.parametrize("split", [256, 2])
def test_candidates_against_all_pairs(spark, data, monkeypatch, split):
    """Recall of the blocks over every pair of forms of an affiliation that the verifier accepts; splitting blocks loses none."""
    monkeypatch.setattr(names, "SPLIT", split)
    people = spark.read.parquet(f"{data}/../sf0.01/records.parquet").selectExpr("explode(authors) as a").select("a.*")
    forms = names.name_forms(people, "affiliation_id", "family", "given")[1]
    groups = {}
    for r in forms.collect():
        groups.setdefault(r.group_id, []).append(r)
    want = set()
    for rows in groups.values():
        for a, b in itertools.combinations(rows, 2):
            same = {a.kind, b.kind} == {"a", "o"} and a.acronym == b.acronym
            if same or a.kind == b.kind == "p" and names.person_score(a.long, a.initials, b.long, b.initials) >= 0.85 or a.kind == b.kind == "o" and names.organisation_score(a.long, b.long) >= 0.85:
                want.add((min(a.id, b.id), max(a.id, b.id)))
    got = [tuple(r) for r in names.candidate_pairs(forms).collect()]
    assert len(got) == len(set(got)) and len(want) > 100
    assert len(want & set(got)) >= 0.99 * len(want)


def test_entities(spark):
    long = "Name" * 5_000
    rows = [("A", "Moostova", "Asel", 1), ("A", "MOOSTOVA", "Asel", 1), ("A", "MOOSTOVA", "Asel", 1), ("A", "Moostova", "A.", 1), ("A", "Moostova", "Ingrid", 1), ("B", "Moostova", "Asel", 1), (None, "Moostova", "Asel", 1),
            ("A", None, "Asel", 1), ("A", " ", "Asel", 1), ("A", "Pellgate Clinical Airway Institute", None, 1), ("A", "PCAI", None, 1), ("A", long, "X", 1), ("A", "李", "雷", 1), ("A", "–", "", None)]
    df = spark.createDataFrame(rows, "affiliation_id string, family string, given string, n int")
    pairs = {tuple(r) for r in names.spelling_pairs(names.name_entities(df)).collect()}
    assert pairs == {
        ("A", "MOOSTOVA|Asel", "Moostova|A."), ("A", "MOOSTOVA|Asel", "Moostova|Asel"), ("A", "Moostova|A.", "Moostova|Asel"), ("A", "PCAI|", "Pellgate Clinical Airway Institute|"),
    }
    assert names.name_entities(df.limit(0)).collect() == []
