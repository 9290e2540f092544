import random
import re
from collections import Counter, defaultdict

import pytest

from tablewash.llm.components import connected_components
from tablewash.llm.near_dedup import Settings, near_duplicates, without_near_duplicates

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_force(texts):
    """Set size and smallest reachable id of each text, all pairs compared."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for ids in holders.values() for a in ids for b in ids if a < b)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(rng, words, copies, changes):
    base = [f"v{rng.randrange(3000)}" for _ in range(words)]
    for _ in range(copies):
        copy = list(base)
        for _ in range(changes):
            copy[rng.randrange(words)] = f"c{rng.randrange(10**6)}"
        yield " ".join(copy)


@pytest.mark.parametrize("settings", [Settings(), Settings(pairs_up_to=3, block=8), Settings(pairs_up_to=3, family=5, block=8)])
def test_equals_brute_force_on_families(spark, settings):
    """Copies, near copies around the threshold without a centre, a passage in common,
    short texts; with every way to compare buckets."""
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [t for changes in (1, 2, 3, 4) for t in family(rng, 150, 25, changes)]
    texts += [f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    texts += ["a b c", "A B c", "a b", "", "  ", None, *texts[:30]]
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    docs = dict(zip(ids, texts))
    found = near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), settings=settings).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_force(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_radius_covers_the_threshold():
    s = Settings()
    assert s.radius == 51 and s.errors == 1 and len(s.edges()) == 27
    # Any way to spread the radius over the chunks leaves one with no more than the errors.
    assert s.chunks * (s.errors + 1) > s.radius


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i + 1, i) for i in range(40)] + [(100 + i, 100) for i in range(30)] + [(None, 5), (7, 7)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_messy_and_empty_tables(messy, empty, messy_rows):
    found = near_duplicates(messy).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 12  # the repeated row is one document
    assert by_id[2].component_id == 1 and not by_id[2].kept
    assert by_id[8].component_id == 7 and by_id[3].n_shingles == 0 and by_id[3].kept
    assert by_id[None].kept and by_id[None].component_id is None
    assert near_duplicates(empty).count() == 0
    kept = without_near_duplicates(messy)
    assert kept.columns == messy.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 9, 10, 11]
