from lexforge.plans import fixtures, queries


def test_caches_take_all_words_of_a_message(spark, tmp_path):
    texts = ["aa bb cc dd ee ff", "gg hh ii jj kk ff aa", "aa bb xx yy", "ff ee dd cc bb aa"]
    spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    hits = lambda f: [r.hit for r in f(spark, str(tmp_path)).orderBy("seq").collect()]
    assert hits(queries.cache_simulation)[:2] == [False, True]
    assert hits(queries.cache_two_level)[:2] == [False, True]
    assert hits(queries.cache_exact) == [False, False, False, True]


def test_levels_of_all_graphs_equal_brute_force(spark):
    data = "/root/testdata/sf0.001"
    needs = {(r.graph, r.id): {(r.graph, x) for x in r.depends_on} for r in fixtures.tasks(spark, data).collect()}
    level, found = {}, True
    while found:
        found = {k: max((level[x] + 1 for x in v if x in needs), default=0) for k, v in needs.items() if k not in level and all(x in level for x in v if x in needs)}
        level |= found
    got = {(r.graph, r.id): r.level for r in queries.dag_levels(spark, data).collect()}
    assert got == {k: level.get(k) for k in needs}
    assert any(g % 10 == 4 and v is None for (g, _), v in got.items()) and any(g % 10 == 4 and v for (g, _), v in got.items())


def test_slugs_of_the_whole_text(spark, tmp_path):
    texts = ["word " * 30 + "End", "! " * 50 + "Late Title"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.text_scalars(spark, str(tmp_path)).orderBy("doc_id").select("doc_id", "slug", "plan_slug").collect()]
    assert got == [(0, "word-" * 30 + "end", ("word_" * 6)[:30]), (1, "late-title", "late_title")]


def kahn(tasks):
    """Places of a graph's tasks: roots by id, then first in, first out, in the order the tasks are listed."""
    known = {t.id for t in tasks}
    wait = {t.id: len({x for x in t.depends_on if x in known}) for t in tasks}
    queue, out = sorted(i for i, n in wait.items() if not n), []
    while queue:
        out.append(queue.pop(0))
        for t in tasks:
            if out[-1] in t.depends_on:
                wait[t.id] -= 1
                if not wait[t.id]:
                    queue.append(t.id)
    return {i: k for k, i in enumerate(out)}


def test_places_and_next_tasks_equal_brute_force(spark):
    data, graphs = "/root/testdata/sf0.001", {}
    for r in fixtures.tasks(spark, data).collect():
        graphs.setdefault(r.graph, []).append(r)
    got = {}
    for r in queries.dag_places(spark, data).collect():
        got[r.graph, r.id] = r.place
    following = {r.graph: r.id for r in queries.next_task(spark, data).collect()}
    want = {}
    for g, tasks in graphs.items():
        tasks.sort(key=lambda t: t.id)
        place = kahn(tasks)
        done = {t.id for t in tasks if t.status == "completed"}
        ready = [t.id for t in tasks if t.status == "pending" and t.id in place and set(t.depends_on) <= done]
        assert {t.id: got[g, t.id] for t in tasks} == {t.id: place.get(t.id) for t in tasks}
        if ready:
            want[g] = min(ready, key=lambda i: got[g, i])
    assert following == want and want
