from lexforge.llm import common


def test_memory_is_given_back_when_a_task_ends_or_is_left(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))

    @common.frugal
    def double(batches):
        for b in batches:
            yield 2 * b

    assert list(double(iter([1, 2]))) == [2, 4] and calls == [1]
    left = double(iter([1, 2]))
    assert next(left) == 2
    left.close()
    assert calls == [1, 1]


def test_memory_can_be_given_back():
    assert common.give_back() is None
