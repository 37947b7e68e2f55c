import numpy as np
import pytest
from pyspark.sql import functions as F

from knowloom.llm import bit_sets, name_links, similar_vectors

# Names -----------------------------------------------------------------------


def test_names_compare():
    same = [("patient", "Katharina Grofilache", "Katharlna Grofilache"), ("patient", "Stajisape Padmavathi", "Padma Stajisape"), ("clinician", "Dr. Ulrike Kabifase", "Kabifase, Ulli A."), ("counterparty", "M/s Levahotu Electricals", "Lev Ahotu Electricals GmbH"), ("facility", "Kurikusto Polyclinic", "Kurikusto Gar. Poly-Clinic")]
    unlike = [("patient", "Anika Shovatrugu", "Quentin Shovatrugu"), ("counterparty", "Jokrafohe Finance LLP", "Jokrafohe Logistics LLP"), ("patient", "Margaret Dafehome", "Margarethe Dafehome")]
    for f, a, b in same:
        assert name_links.accept(name_links.parse(f, a), name_links.parse(f, b)), (a, b)
    for f, a, b in unlike:
        assert not name_links.accept(name_links.parse(f, a), name_links.parse(f, b)), (a, b)
    assert name_links.parse("patient", "  ") is None and name_links.parse("patient", "12") is None and name_links.parse("patient", None) is None


def test_jaro_winkler_and_edits():
    assert name_links.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert name_links.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert name_links.one_edit("abcd", "abdc") and name_links.one_edit("abc", "abcd") and not name_links.one_edit("abc", "cba")


def edited(rng, w, times):
    for _ in range(times):
        i = rng.randrange(1, len(w) - 1)
        w = rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + rng.choice("abdeklrsu") + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])
    return w


def test_every_accepted_pair_shares_a_block():
    import random

    rng = random.Random(1)
    syllables = ["ka", "tri", "sho", "bhu", "le", "mo", "gra", "ji"]
    accepted = two = 0
    for _ in range(800):
        w = "".join(rng.choice(syllables) for _ in range(rng.choice((2, 4))))
        v = edited(rng, w, 1)
        if name_links.same_core(w, v):
            accepted += 1
            assert set(name_links.block_keys(w)) & set(name_links.block_keys(v)), (w, v)
            # The phonetic codes alone would do for every single edit of a long core.
            keys = [set(name_links.token_keys(x, "anna")) for x in (w, v)]
            assert keys[0] & keys[1] or min(len(w), len(v)) < name_links.LONG_CORE, (w, v)
        # A vowel and another letter: two edits, of which the code shows one.
        i = next(i for i, c in enumerate(w) if c in "aeiou")
        x = w[:i] + ("e" if w[i] != "e" else "o") + w[i + 1 :]
        x = x[: i + 2] + rng.choice("dklrs") + x[i + 3 :]
        if min(len(x), len(w)) >= name_links.LONG_CORE and name_links.same_core(w, x) and not name_links.one_edit(w, x):
            two += 1
            assert set(name_links.token_keys(w, "anna")) & set(name_links.token_keys(x, "anna")), (w, x)
    assert accepted > 400 and two > 30


def test_names_of_no_list(spark):
    people = [("Elizabeth Oldenburg", "Liz Oldenburg"), ("Oldenburg, Betty", "Elizabeth Oldenburg"), ("Michael Strandgaard", "Mike Strandgard"), ("Thandiwe Nkosana", "Nkosana, Thandiwe"), ("Rosalind Brandstetter", "Rosalind Brandztettar"), ("Dr. Wim Terpstra", "Wim Terpstra")]
    firms = [("Acme Chemicals Ltd", "ACME CHEMICALS"), ("Acme Chemicals Ltd", "Chemicals, Acme Limited"), ("Acme Chemicals", "Acme Chemikals GmbH"), ("Borealis Shipyard Inc.", "Borealis Shipyard")]
    other = ["Acme Shipyard Ltd", "Elizabeth Altenburg", "Ann Oldenburg", "Borealis Chemicals Ltd"]
    names = sorted({n for p in people for n in p} | {other[1], other[2]})
    med = spark.createDataFrame([(n, None, None) for n in names], "patient string, clinician string, facility string")
    fin = spark.createDataFrame([(n,) for n in sorted({n for p in firms for n in p} | {other[0], other[3]})], "counterparty string")
    got = {(r.name_a, r.name_b) for r in name_links.found(fin, med).collect()}
    assert {tuple(sorted(p)) for p in people + firms} <= got
    assert not any(o in p for o in other for p in got)


def test_components_of_a_chain(spark):
    n = 60
    nodes = spark.createDataFrame([(f"{i:03d}",) for i in range(n + 1)], "id string")
    pairs = [(f"{i:03d}", f"{i + 1:03d}") for i in range(n - 1)]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "a string, b string")
    got = {r.id: r.component for r in name_links.components(nodes, edges).collect()}
    assert set(got.values()) == {"000", f"{n:03d}"} and got[f"{n:03d}"] == f"{n:03d}"


def test_link_tables(spark):
    fin = spark.createDataFrame([(x,) for x in ["Badri Traders GmbH", "BADRI TRADERS", None, "", "Badri Finance LLP"] + ["Badri Traders GmbH"] * 5], "counterparty string").withColumn("name", F.lit("clash"))
    med = spark.createDataFrame([("Kiran Galareba", "Dr. Uma Drofarikre", None), ("K. Galareba", "Uma Drofarikre, MD", None), ("Kavya Zibapridu", None, "Legigido Hospital"), ("K. Zibapridu", None, "The Legigido Memorial Hosp.")], "patient string, clinician string, facility string")
    got = {tuple(r) for r in name_links.found(fin, med).collect()}
    assert got == {
        ("counterparty", "BADRI TRADERS", "Badri Traders GmbH"), ("patient", "K. Galareba", "Kiran Galareba"), ("patient", "K. Zibapridu", "Kavya Zibapridu"),
        ("clinician", "Dr. Uma Drofarikre", "Uma Drofarikre, MD"), ("facility", "Legigido Hospital", "The Legigido Memorial Hosp."),
    }
    assert name_links.found(fin.filter("false"), med.filter("false")).count() == 0


# Vectors ---------------------------------------------------------------------


def brute(rows, k, least):
    out = set()
    for i, (a, ca, ma, va) in enumerate(rows):
        if va is None or not np.any(va):
            continue
        sims = []
        for b, cb, mb, vb in rows[:i] + rows[i + 1 :]:
            if mb == ma and cb != ca and vb is not None and np.any(vb):
                s = float(np.dot(va, vb) / np.linalg.norm(va) / np.linalg.norm(vb))
                if s >= least:
                    sims.append((-round(s, 6), b))
        out |= {(min(a, b), max(a, b)) for _, b in sorted(sims)[:k]}
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        v = rng.standard_normal(32)
        rows.append((f"e{i:04d}", f"c{i}", "m", v))
        if i % 4 == 0:
            rows.append((f"n{i:04d}", f"d{i}", "m", 3 * (v + 0.25 * rng.standard_normal(32))))
    rows += [("same1", "c0", "m", rows[0][3] * 2), ("zero", "z", "m", np.zeros(32)), ("null", "z", "m", None), ("other", "o", "m2", rows[0][3])]
    # Many copies of one direction: each row has its five smallest neighbours.
    rows += [(f"copy{i:03d}", f"k{i % 40}", "m", np.ones(32) * (1 + i % 3)) for i in range(300)]
    df = spark.createDataFrame([(a, c, m, None if v is None else [float(x) for x in v]) for a, c, m, v in rows], "embedding_id string, content_id string, model string, vector array<float>")
    got = {tuple(r) for r in similar_vectors.found(df.withColumn("rank", F.lit("clash"))).collect()}
    want = brute(rows, 5, 0.85)
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)
    copies = lambda s: {p for p in s if p[0].startswith("copy")}
    assert copies(got) == copies(want)


def test_crowded_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(similar_vectors, "HOT", 20)
    rng = np.random.default_rng(5)
    base = rng.standard_normal(32)
    rows = [(f"e{i:04d}", f"c{i}", "m", base + 0.02 * rng.standard_normal(32)) for i in range(150)]
    df = spark.createDataFrame([(a, c, m, [float(x) for x in v]) for a, c, m, v in rows], "embedding_id string, content_id string, model string, vector array<float>")
    got = {tuple(r) for r in similar_vectors.found(df).collect()}
    want = brute_by_product(rows, 5, 0.85)
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


def test_tables_are_searched_in_passes_where_the_bit_set_is_too_small(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(f"e{i:04d}", f"c{i}", "m", rng.standard_normal(32)) for i in range(500)]
    rows += [(f"n{i:04d}", f"d{i}", None if i % 2 else "m", rows[i][3] + 0.3 * rng.standard_normal(32)) for i in range(200)]
    whole = {tuple(r) for r in similar_vectors.found(vector_rows(spark, rows)).collect()}
    monkeypatch.setattr(bit_sets, "MAX_BITS", 1 << 16)
    assert {tuple(r) for r in similar_vectors.found(vector_rows(spark, rows)).collect()} == whole


def test_empty_vectors(spark):
    df = spark.createDataFrame([], "embedding_id string, content_id string, model string, vector array<float>")
    assert similar_vectors.found(df).count() == 0


def vector_rows(spark, rows):
    return spark.createDataFrame([(a, c, m, [float(x) for x in v]) for a, c, m, v in rows], "embedding_id string, content_id string, model string, vector array<float>")


def test_a_dense_cluster_loses_no_neighbours(spark, monkeypatch):
    monkeypatch.setattr(similar_vectors, "HOT", 16)
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x)
    base = unit(rng.standard_normal(64))
    # Half of the rows at a cosine of about 0.95 to each other, more than a cell may hold.
    rows = [(f"e{i:04d}", f"c{i % 300}", "m", unit(base + 0.23 * unit(rng.standard_normal(64)))) for i in range(1500)]
    rows += [(f"r{i:04d}", f"d{i}", "m", rng.standard_normal(64)) for i in range(1500)]
    got = {tuple(r) for r in similar_vectors.found(vector_rows(spark, rows)).collect()}
    want = brute_by_product(rows, 5, 0.85)
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


def brute_by_product(rows, k, least):
    v = np.array([np.float32(r[3]) for r in rows], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    contents = np.array([r[1] for r in rows])
    out = set()
    for i, r in enumerate(rows):
        s = np.where(contents == r[1], -2, v @ v[i])
        for j in np.argsort(-s, kind="stable")[:k]:
            if s[j] >= least:
                out.add((min(r[0], rows[j][0]), max(r[0], rows[j][0])))
    return out


def test_modelled_recall_holds_at_every_size():
    import inspect

    given = {n: p.default for n, p in inspect.signature(similar_vectors.similar_vectors).parameters.items()}
    rng = np.random.default_rng(2)
    x, z = rng.standard_normal((2, 1000, 128))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    y = 0.85 * x + np.sqrt(1 - 0.85**2) * z / np.linalg.norm(z, axis=1)[:, None]
    for n in (14_000, 140_000, 1_400_000):
        m = similar_vectors.default_functions(n)
        probes = given["probes"] or similar_vectors.default_probes(n)
        tables = given["tables"] or similar_vectors.default_tables(m, given["width"], probes, 0.85)
        met = np.zeros(1000, bool)
        for t in range(tables):
            a, b = (similar_vectors._with_probes(*similar_vectors._cells(v.astype(np.float32), m, t, given["width"], 20240), probes) for v in (x, y))
            met |= (a == b[0]).any(0) | (b == a[0]).any(0)
        assert met.mean() >= 0.9, (n, met.mean())


def test_the_query_gives_every_row_its_whole_five(spark, tmp_path):
    from knowloom.llm import queries

    rng = np.random.default_rng(4)
    rows = [(f"e{i:04d}", f"c{i % 90}", "m", rng.standard_normal(32)) for i in range(600)]
    rows += [(f"x{i:04d}", f"x{i}", "m", rows[i][3] * 2) for i in range(60)]
    rows += [("y0000", "y", "m", rows[0][3]), ("lone", "c0", "m2", rows[0][3]), ("zero", "c0", "m", np.zeros(32))]
    vector_rows(spark, rows).write.parquet(str(tmp_path / "chunk_embeddings.parquet"))
    got = queries.p1_neighbours(spark, str(tmp_path)).collect()
    v = np.array([np.float32(r[3]) for r in rows[:-2]], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids, contents = np.array([r[0] for r in rows[:-2]]), np.array([r[1] for r in rows[:-2]])
    want = {}
    for i, a in enumerate(ids):
        s = np.where(contents == contents[i], -2, v @ v[i])
        for rank, j in enumerate(sorted(range(len(ids)), key=lambda j: (-round(s[j], 6), ids[j]))[:5], 1):
            want[a, rank] = (ids[j], s[j])
    assert {(r.embedding_id, r["rank"]): r.neighbour_id for r in got} == {key: b for key, (b, _) in want.items()}
    assert all(abs(r.similarity - want[r.embedding_id, r["rank"]][1]) < 1e-6 for r in got)


def test_pairs_do_not_depend_on_the_size_of_a_block(spark, monkeypatch):
    pairs = [("weber", "wefer"), ("meyer", "meier"), ("patel", "padel"), ("gupta", "gubta"), ("kumar", "kunar"), ("mohan", "moahn"), ("mohan", "mokan"), ("sharma", "shrama"), ("hartrodt", "harrodt"), ("aiyau", "aiyou")]
    names = {s for p in pairs for s in p} | {"solano", "drifake"}
    med = spark.createDataFrame([(f"{g} {s.title()}", None, None) for s in names for g in ("Kavya", "Uma")], "patient string, clinician string, facility string")
    fin = spark.createDataFrame([], "counterparty string")
    found = lambda: {(r.name_a, r.name_b) for r in name_links.found(fin, med).collect()}
    small = found()
    monkeypatch.setattr(name_links, "LARGE_BLOCK", 1)
    assert found() == small
    accepted = {tuple(sorted((f"{g} {a.title()}", f"{g} {b.title()}"))) for a, b in pairs if name_links.same_core(a, b) for g in ("Kavya", "Uma")}
    assert len(accepted) >= 18 and accepted <= small and not any("Uma" in a + b and "Kavya" in a + b for a, b in small)
