import random

from marketlens.operators import stats


def walk(rows, per_domain, per_category):
    room, kept = {}, []
    for session, i, domain, category, score in sorted(rows, key=lambda r: (-r[4], r[1])):
        keys = (session, "d", domain), (session, "c", category)
        if room.get(keys[0], 0) < per_domain and room.get(keys[1], 0) < per_category:
            kept.append((session, i))
            for k in keys:
                room[k] = room.get(k, 0) + 1
    return sorted(kept)


def pages(spark):
    rng = random.Random(5)
    rows = [(i % 2, i, f"d{rng.randrange(6)}", f"c{rng.randrange(3)}", rng.randrange(50) / 49) for i in range(400)]
    return rows, spark.createDataFrame(rows, "session_id int, id long, domain string, primary_category string, score double")


def test_walk_sees_a_bounded_number_of_pages_and_stays_exact(spark):
    rows, df = pages(spark)
    for caps in ((4, 7), (7, 4), (3, 1000)):
        out = stats.cap_pages(df, *caps)
        assert "row_number" in out._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r.session_id, r.id) for r in out.collect()) == walk(rows, *caps)


def test_funnel_counts_what_the_selection_keeps(spark):
    rows, df = pages(spark)
    df = df.selectExpr("*", "concat('u', id) as canonical_url", "concat('u', id) as url", "timestamp_ntz'2024-01-01' as crawled_at")
    kept = walk([r for r in rows if r[4] >= 0.5], 6, 9)
    got = {r.session_id: r.capped for r in stats.filter_funnel(df, 0.5, 6, 9).collect()}
    assert got == {s: sum(k[0] == s for k in kept) for s in (0, 1)}
    assert stats.select_pages(df, 0.5, 6, 9).count() == len(kept)
