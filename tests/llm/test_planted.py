"""Cutoffs of the pairs' defects come from all sound pairs, however many, long or rare."""

import pytest

from tickforge.llm import pairs


@pytest.fixture
def table(spark):
    rows = [(k, "What did Acme say about peak load?", f"Acme reports that peak load rose by {k}% in the year, and it expects the same.") for k in range(1200)]
    rows += [(2000 + k, "Was sagt Acme über Strom?", f"Das Unternehmen sagt, dass die Kosten für Strom im Jahr um {k} % stiegen.") for k in range(3)]
    rows += [(3000 + k, None, f"Spending on wind turbines rose by {k}% and the company expects no change.") for k in range(20)]
    rows += [(4000 + k, "What did Acme say about wind?", "Spending on wind turbines rose sharply in the year. " * 100) for k in range(20)]
    rows += [(5000 + k, "What did Acme say about peak load?", "I cannot answer this question.") for k in range(30)]
    return spark.createDataFrame(rows, "answer_id BIGINT, question STRING, answer STRING")


def test_every_sound_pair_is_planted(table, monkeypatch):
    calls, cutoff = [], pairs.best_cutoff

    def seen(sound, planted, n_sound=None, n_planted=None):
        calls.append((len(sound) if n_sound is None else sum(n_sound), len(planted) if n_planted is None else sum(n_planted)))
        return cutoff(sound, planted, *([n_sound, n_planted] if n_sound is not None else []))

    monkeypatch.setattr(pairs, "best_cutoff", seen)
    monkeypatch.setattr(pairs, "PLANTED_TOGETHER", 100, raising=False)  # 13 groups, of which three have a German pair at most
    pairs.fit(table)
    asked = {"copied": 1223, "language": 1223}  # not those without a question
    assert dict(zip(pairs.FUNCTIONS, calls)) == {d: (1243, asked.get(d, 1243)) for d in pairs.FUNCTIONS}


def test_planted_pairs_do_not_depend_on_partitions(table, monkeypatch):
    got, cutoff = [], pairs.best_cutoff
    monkeypatch.setattr(pairs, "best_cutoff", lambda *a: (got[-1].append([sorted(zip(a[k], a[k + 2])) for k in (0, 1)]), cutoff(*a))[1])
    for n in (1, 7):
        got.append([])
        pairs.fit(table.repartition(n))
    assert got[0] == got[1]


def test_counted_posteriors_are_repeated_posteriors():
    assert pairs.best_cutoff([0.1, 0.4], [0.9, 0.3], [5, 2], [1, 3]) == pairs.best_cutoff([0.1] * 5 + [0.4] * 2, [0.9] + [0.3] * 3)
    assert pairs.best_cutoff([0.1, 0.4], [0.4, 0.9], [50, 1], [40, 9]) <= 0.4 < pairs.best_cutoff([0.1, 0.4], [0.4, 0.9], [50, 90], [1, 9])
