"""Turns joined and paired: how many blocks a task gets."""


def test_a_tasks_blocks_are_bounded(spark, monkeypatch):
    """a task's memory grew with the table, as its share followed from the compressed size."""
    from convlake import repair

    monkeypatch.setattr(repair, "TASK_BLOCKS", 10)
    kind = "CASE id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'tool_use' ELSE 'tool_result' END AS type"
    call = "CASE id % 3 WHEN 1 THEN 'c' || id WHEN 2 THEN 'c' || (id - 1) END AS call"
    blocks = spark.range(400).selectExpr("cast(id % 40 AS string) AS session_id", "id div 80 AS id", "cast(id div 40 % 2 AS int) AS pos", "if(id % 2 = 0, 'user', 'agent') AS participant", kind, call, "'x' AS text")
    turns = repair.drop_unpaired(repair.join_turns(repair.split_turns(blocks)))
    plan = turns._jdf.queryExecution().executedPlan().toString()
    assert ", 40), REPARTITION_BY_NUM" in plan and "SortMergeJoin" not in plan
    assert turns.where("type is null or session_id is null").isEmpty() and turns.select("session_id").distinct().count() == 40


def test_entries_are_split_in_bounded_tasks(spark, monkeypatch):
    """what a task sorts when entries are split grew with the table; only joining was bounded."""
    import re

    from convlake import repair

    monkeypatch.setattr(repair, "TASK_BLOCKS", 10)
    blocks = spark.range(400).selectExpr("cast(id % 4 AS string) AS session_id", "id div 8 AS id", "cast(id div 4 % 2 AS int) AS pos", "'agent' AS participant", "if(id div 4 % 2 = 0, 'text', 'tool_result') AS type", "'c' AS call", "'x' AS text")
    plan = repair.normalize_turns(blocks)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^()]*)\), (\w+)", plan)
    assert [kind for _, kind in dealt] == ["REPARTITION_BY_NUM"] * 2 and all(keys.endswith(", 40") for keys, _ in dealt), plan
    parts = repair.split_turns(blocks)
    assert parts.count() == 400 and parts.where("part <> pos or (type = 'tool_result') <> (participant = 'user')").isEmpty()
