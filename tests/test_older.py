"""Files of the older workflow: both layouts, counts that are not doubled, checkpoints."""

import json

import pytest

from lodecraft.sources import older

DOCUMENT = {
    "trajectories": [
        {
            "query": 'say "hi"\n', "route_decision": "direct", "final_answer": "hi", "success": True, "total_reward": 0.9, "steps": 2, "timestamp": "2024-01-01T00:00:00", "metadata": {"k": [1, {"z": None}]},
            "transitions": [{"state": {"status": "planning", "n": 0}, "action": "planner", "next_state": {"status": "x"}, "reward": 0.1, "done": False, "info": {}}, {"state": {}, "action": "tool", "next_state": {}, "reward": 0.8, "done": True}],
        },
        {"query": "q2", "route_decision": "r", "transitions": [], "final_answer": "", "success": False, "total_reward": 5.0, "steps": 7, "timestamp": "t"},
    ],
    "statistics": {"count": 2},
    "exported_at": "now",
}


def test_layouts_round_trip(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(DOCUMENT, indent=2))
    first = older.read_trajectories(spark, str(tmp_path / "one.json"), "document")
    rows = {r["query"]: r for r in first.collect()}
    one, two = rows['say "hi"\n'], rows["q2"]
    assert (one.steps, one.total_reward, two.steps, two.total_reward, two.transitions) == (2, 0.9, 0, 0.0, [])
    assert json.loads(one.transitions[0].state) == {"status": "planning", "n": 0} and json.loads(one.metadata) == {"k": [1, {"z": None}]}
    older.write_trajectories(first, str(tmp_path / "lines"))
    again = older.read_trajectories(spark, str(tmp_path / "lines"))
    assert again.columns == first.columns
    found = {r["query"]: r for r in again.collect()}
    assert found['say "hi"\n'].transitions[1].action == "tool" and json.loads(found['say "hi"\n'].metadata) == {"k": [1, {"z": None}]}
    assert {q: (r.steps, r.total_reward, r.success) for q, r in found.items()} == {q: (r.steps, r.total_reward, r.success) for q, r in rows.items()}
    with pytest.raises(ValueError, match="unknown layout"):
        older.read_trajectories(spark, "x", "other")


def test_checkpoint(spark, tmp_path):
    path = str(tmp_path / "check.json")
    metrics = [{"episode": k, "avg_reward": k / 2, "success_rate": 0.5, "avg_steps": 3.0, "timestamp": f"t{k}"} for k in range(3)]
    older.write_checkpoint(spark, path, {"batch": 8}, 3, metrics, "now")
    config, episode, rows = older.read_checkpoint(spark, path)
    assert (config, episode) == ({"batch": 8}, 3)
    assert [(r.place, r.episode, r.avg_reward, r.timestamp) for r in rows.orderBy("place").collect()] == [(k, k, k / 2, f"t{k}") for k in range(3)]
    older.write_checkpoint(spark, path, {}, 0, [], "later")
    assert older.read_checkpoint(spark, path)[2].collect() == []
