"""What leaves a Python worker at once is bounded, whatever the batch."""

from corpusloom.operators import chunking


def test_frames_are_sent_as_they_fill(monkeypatch):
    monkeypatch.setattr(chunking, "FRAME_CHARS", 100)
    taken = []

    def rows():
        for k in range(50):
            taken.append(k)
            yield f"p{k}", k, "x" * 30

    sent = chunking.frames(rows(), ["path", "no", "content"])
    assert len(next(sent)) == len(taken) == 4  # no further row was cut
    rest = [len(f) for f in sent]
    assert sum(rest) == 46 and max(rest) <= 4


def test_no_rows_are_an_empty_frame():
    assert [list(f.columns) for f in chunking.frames(iter(()), ["a", "b"])] == [["a", "b"]]
