import itertools
import random
import re

from logweave.llm.minhash import near_duplicates

DOCS = "doc_id bigint, text string"


def brute_force(rows, k, percent):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i), i == find(i)) for i, s in sets.items())


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(near_duplicates(docs)) == brute_force(rows, 4, 80)


def test_a_group_of_edited_copies_in_small_blocks(spark):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for n in range(60):
        words = list(base)
        for j in range(n % 7):
            words[(n * 13 + j * 31) % 120] = f"x{n}-{j}"
        rows.append((n, " ".join(words)))
    docs = spark.createDataFrame(rows, DOCS)
    assert got(near_duplicates(docs, block=4)) == brute_force(rows, 4, 80)


def test_nulls_empty_short_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b c"), (7, "A B C"), (8, "a b c d"), (None, "one")]
    docs = spark.createDataFrame([(i, t, 0, 1) for i, t in [*rows, rows[3]]], DOCS + ", component_id int, n_shingles int")
    out = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert out == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 8, True), (None, 1, None, None)}
    assert near_duplicates(docs).count() == 10
    assert near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_repeat_an_id_with_other_texts(spark):
    rnd = random.Random(3)
    a, b = ([f"{c}{rnd.randrange(10**6)}" for _ in range(60)] for c in "ab")
    near = lambda w, i: " ".join([*w[:i], "x", *w[i + 1 :]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 30)), (3, near(b, 30)), (3, "alone"), (4, near(a, 59))]
    got_ = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got_ == {(1, 57, 1), (2, 57, 1), (3, 57, 1), (3, 1, 3), (4, 57, 1)}
