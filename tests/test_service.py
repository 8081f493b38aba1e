import threading

from siftlake.plans.service import Kept, Queue


def test_kept_answers_expire():
    now = [0.0]
    kept, made = Kept(5, lambda: now[0]), []
    ask = lambda **p: kept.get("feed", p, lambda: made.append(1) or len(made))
    assert (ask(a=1, b=2), ask(b=2, a=1), ask(a=2)) == (1, 1, 2)
    now[0] = 6
    assert ask(a=1, b=2) == 3
    kept.forget("feed")
    assert ask(a=1, b=2) == 4


def test_queue_is_serial_and_cancels_what_waits():
    queue, gate, order = Queue(), threading.Event(), []
    one = queue.submit("1", lambda: gate.wait(10) and order.append(1))
    two = queue.submit("2", lambda: order.append(2))
    three = queue.submit("3", lambda: 1 / 0)
    four = queue.submit("4", lambda: order.append(4) or "ok")
    while one.state == "queued":
        pass
    assert queue.positions() == ["2", "3", "4"] and queue.cancel("2") and not queue.cancel("1")
    gate.set()
    assert four.done.wait(10) and (one.state, two.state, three.state, four.result) == ("completed", "cancelled", "failed", "ok")
    assert order == [1, 4]
