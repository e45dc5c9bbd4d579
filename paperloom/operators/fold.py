"""The sequential rule of the numbering, as it runs inside tasks.

Plain Python over Arrow batches and nothing of Spark, so a worker starts it without loading more.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa

# Why a page was refused, as reports word it.
NO_DETECTIONS = "No detections found on page"
NO_MARKER = "Question detected before any option/part marker was read"
GAP = "Question numbering leaves a gap"
# A page read after its reviewer dropped what it was handed.
DISCARDED = "carried pieces dropped"

# Steps of a page's rows in fold order.
STATE_STEP, FOLDER_STEP, HEADER_STEP, REGION_STEP = -1, 0, 1, 2

INPUT = (
    "book", "_seg", "page_key", "page", "_step", "ord", "label", "reading_option", "reading_part", "joins_next",
    "detected", "skip", "discard", "entry_option", "entry_part", "entry_question", "_state",
)

FOLDED = (
    "kind string, book string, page_key string, page string, ord long, position long, option int, part string, number long, "
    "pieces long, carried long, outcome string, cause string, questions long, held long, carried_out long, entry_group long, "
    "entry_option int, entry_part string, entry_question long, exit_option int, exit_part string, exit_question long, "
    "fault_position long, fault_option int, fault_part string, fault_number long, fault_free long, continue_helps boolean"
)
SUMMARY = "book string, _seg long, summary string"
STATE = "book string, _seg long, _state string"
Batches = Iterator[pa.RecordBatch]
FOLDED_NAMES = [c.split()[0] for c in FOLDED.split(", ")]


@dataclass
class _Book:
    """Where one book's numbering stands, and the page being read."""

    option: int = 0
    part: str = ""
    question: int = 0
    carry: int = 0
    highs: dict = field(default_factory=dict)

    def enter(self, row) -> dict | None:
        """Begin a page; the page's report at once when it is not read at all."""
        self.page = row
        self.live = False
        if not row.detected:
            return self._report("failed", NO_DETECTIONS)
        if row.skip:
            return self._report("skipped", None)
        if row.entry_option is not None:
            self.option, self.part, self.question = row.entry_option, row.entry_part or "", row.entry_question or 0
        self.dropped = DISCARDED if row.discard and self.carry else None
        self.pending, self.carry = (0 if row.discard else self.carry), 0
        self.entry = (self.option, self.part, self.question)
        self.pieces = self.placed = self.entry_group = 0
        self.marked = self.joined = False
        self.checked = self.fault = None
        self.new_highs: dict = {}
        self.taken = self.pending
        self.live = True
        return None

    def read(self, row) -> dict | None:
        """One region; a placed question's row when it places one."""
        if row.label == "option":
            self.marked = True
            if row.reading_option is not None and row.reading_option == self.option + 1:
                self.option, self.part, self.question = row.reading_option, "A", 0
            return None
        if row.label == "part":
            self.marked = True
            if row.reading_part is not None and row.reading_part != self.part:
                self.part, self.question = row.reading_part, 0
            return None
        if not self.marked:
            self.entry_group += 0 if self.joined else 1
        self.joined = row.joins_next
        self.pieces += 1
        if row.joins_next:
            return None
        if self.placed == 0 and not (self.option and self.part):
            return self._refuse(NO_MARKER)
        number, folder = self.question + 1, (self.option, self.part)
        if folder != self.checked:
            self.checked = folder
            free = self.highs.get(folder, 0) + 1
            if self.fault is None and number != free:
                if number > free:
                    return self._refuse(GAP)
                self.fault = (self.placed, self.option, self.part, number, free)
        done = {
            "kind": "question", "ord": row.ord, "position": self.placed, "option": self.option, "part": self.part,
            "number": number, "pieces": self.pieces, "carried": self.pending,
        }
        self.question, self.pieces, self.pending = number, 0, 0
        self.new_highs[folder] = max(self.new_highs.get(folder, 0), number)
        self.placed += 1
        return done

    def leave(self) -> dict | None:
        """End a page that came through."""
        if not self.live:
            return None
        self.live = False
        for folder, number in self.new_highs.items():
            self.highs[folder] = max(self.highs.get(folder, 0), number)
        self.carry = self.pending + self.pieces
        report = self._report("read", self.dropped, questions=self.placed, held=self.pieces, entry_group=self.entry_group)
        report |= dict(zip(("entry_option", "entry_part", "entry_question"), self.entry))
        if self.fault:
            names = ("fault_position", "fault_option", "fault_part", "fault_number", "fault_free")
            report |= dict(zip(names, self.fault)) | {"continue_helps": self.fault[0] < self.entry_group}
        return report

    def _refuse(self, cause: str) -> dict:
        """The page's first question cannot be placed: the page is refused and its carry is lost."""
        self.live = False
        self.option, self.part, self.question = self.entry
        report = self._report("failed", cause)
        return report | dict(zip(("entry_option", "entry_part", "entry_question"), self.entry)) | {"carried": self.taken}

    def _report(self, outcome: str, cause: str | None, **counts) -> dict:
        return {
            "kind": "page", "outcome": outcome, "cause": cause, "carried_out": self.carry,
            "carried": getattr(self, "taken", 0) if outcome == "read" else 0,
            "exit_option": self.option, "exit_part": self.part, "exit_question": self.question, **counts,
        }

    def dump(self) -> str:
        highs = [[o, p, n] for (o, p), n in self.highs.items()]
        return json.dumps([self.option, self.part, self.question, self.carry, highs])

    @staticmethod
    def load(text: str) -> _Book:
        option, part, question, carry, highs = json.loads(text)
        return _Book(option, part, question, carry, {(o, p): n for o, p, n in highs})


_Row = namedtuple("_Row", [name.lstrip("_") for name in INPUT])


def _rows(batches: Batches) -> Iterator[_Row]:
    """Fold rows one by one; only a batch at a time is in Python."""
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in INPUT]
        yield from map(_Row._make, zip(*columns))


def _batches(records: Iterator[dict], schema: str, size: int = 20_000) -> Batches:
    wanted = _arrow_schema(schema)
    held: list[dict] = []
    for record in records:
        held.append(record)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=wanted)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=wanted)


def _arrow_schema(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (column.split() for column in schema.split(", "))])


def fold_books(batches: Batches) -> Batches:
    """Fold sorted rows, one row at a time: memory does not grow with a book or a page."""

    def records():
        at, book = None, _Book()
        where = {}
        for row in _rows(batches):
            if (row.book, row.seg) != at:
                if at is not None and (last := book.leave()):
                    yield last | where
                at, book = (row.book, row.seg), _Book()
                book.live = False
            if row.step == STATE_STEP:
                book = _Book.load(row.state)
                book.live = False
            elif row.step == FOLDER_STEP:
                book.highs[(row.reading_option, row.reading_part)] = row.entry_question
            elif row.step == HEADER_STEP:
                if last := book.leave():
                    yield last | where
                where = {"book": row.book, "page_key": row.page_key, "page": row.page}
                if report := book.enter(row):
                    yield report | where
            elif book.live and (done := book.read(row)):
                yield done | where
        if at is not None and (last := book.leave()):
            yield last | where

    return _batches(records(), FOLDED)


@dataclass
class _Track:
    """One entry state followed through a segment with its counter and carry left symbolic.

    ``question`` counts from the unknown entry counter while ``relative`` holds; ``ahead`` says that
    counter lies past the folder's end, which refuses any page that would continue from it.
    """

    option: int
    part: str
    ahead: bool
    question: int = 0
    relative: bool = True
    keeps_carry: bool = True
    carry: int = 0
    moved: bool = False
    highs: dict = field(default_factory=dict)
    relative_high: int | None = None

    def enter(self, row) -> None:
        self.live = False
        if not row.detected or row.skip:
            return
        self.entry = (self.option, self.part, self.ahead, self.question, self.relative, self.moved)
        self.pending = (False, 0) if row.discard else (self.keeps_carry, self.carry)
        self.keeps_carry, self.carry = False, 0
        self.pieces = self.placed = 0
        self.page_highs: list = []
        self.live = True

    def read(self, row) -> None:
        if row.label == "option":
            if row.reading_option is not None and row.reading_option == self.option + 1:
                self._reset(row.reading_option, "A")
            return
        if row.label == "part":
            if row.reading_part is not None and row.reading_part != self.part:
                self._reset(self.option, row.reading_part, self.moved)
            return
        self.pieces += 1
        if row.joins_next:
            return
        if self.placed == 0 and (self.ahead or not (self.option and self.part)):
            self.option, self.part, self.ahead, self.question, self.relative, self.moved = self.entry
            self.live = False
            return
        self.question += 1
        self.placed += 1
        self.pieces, self.pending = 0, (False, 0)
        # An option not yet moved from is the unknown one the segment was entered with.
        self.page_highs.append((self.option if self.moved else None, self.part, self.relative, self.question))

    def _reset(self, option: int, part: str, moved: bool = True) -> None:
        self.option, self.part, self.question = option, part, 0
        self.ahead = self.relative = False
        self.moved = moved

    def leave(self) -> None:
        if not self.live:
            return
        self.live = False
        for option, part, relative, number in self.page_highs:
            if relative:
                self.relative_high = max(self.relative_high or 0, number)
            else:
                self.highs[(option, part)] = max(self.highs.get((option, part), 0), number)
        keeps, count = self.pending
        self.keeps_carry, self.carry = keeps, count + self.pieces

    def dump(self) -> list:
        highs = [[o, p, n] for (o, p), n in self.highs.items()]
        return [
            self.option if self.moved else None, self.part, self.relative, self.question,
            self.keeps_carry, self.carry, highs, self.relative_high,
        ]


def _entry_states(top: int, ahead: bool) -> list[tuple[int, str, bool]]:
    states = [(o, p) for o in range(top + 1) for p in (("", "A", "B") if o == 0 or ahead else ("A", "B"))]
    return [(o, p, a) for o, p in states for a in ((False, True) if ahead else (False,))]


def sum_up_segments(top: int, ahead: bool):
    """Sum each segment up as a table from entry state to exit state."""

    def run(batches: Batches) -> Batches:
        def records():
            at, tracks, folders, entry = None, {}, [], None

            def close():
                for track in tracks.values():
                    track.leave()
                table = {f"{o}|{p}|{int(a)}": t.dump() for (o, p, a), t in tracks.items()}
                return {"book": at[0], "_seg": at[1], "summary": json.dumps([folders, entry, table])}

            for row in _rows(batches):
                if (row.book, row.seg) != at:
                    if at is not None:
                        yield close()
                    at, folders, entry = (row.book, row.seg), [], None
                    tracks = {s: _Track(*s) for s in _entry_states(top, ahead)}
                    for track in tracks.values():
                        track.live = False
                if row.step == FOLDER_STEP:
                    folders.append([row.reading_option, row.reading_part, row.entry_question])
                elif row.step == HEADER_STEP:
                    if row.entry_option is not None and row.detected and not row.skip:
                        entry = [row.entry_option, row.entry_part or "", row.entry_question or 0]
                    for track in tracks.values():
                        track.leave()
                        track.enter(row)
                elif row.step == REGION_STEP:
                    for track in tracks.values():
                        if track.live:
                            track.read(row)
            if at is not None:
                yield close()

        return _batches(records(), SUMMARY)

    return run


def chain_segments(top: int):
    """Walk a book's segment tables in order and hand each segment its entry state."""

    def run(batches: Batches) -> Batches:
        def records():
            at, book = None, _Book()
            for batch in batches:
                for name, seg, summary in zip(*(batch.column(c).to_pylist() for c in ("book", "_seg", "summary"))):
                    if name != at:
                        at, book = name, _Book()
                    folders, entry, table = json.loads(summary)
                    for option, part, number in folders:
                        book.highs[(option, part)] = number
                    yield {"book": name, "_seg": seg, "_state": book.dump()}
                    if entry:
                        book.option, book.part, book.question = entry
                    folder = (book.option, book.part)
                    ahead = book.question > book.highs.get(folder, 0)
                    row = table.get(f"{min(book.option, top)}|{book.part}|{int(ahead)}")
                    if row is None:
                        raise ValueError(f"book {name} is entered at {book.option}/{book.part}, which is no option and part")
                    option, part, relative, question, keeps, carry, highs, relative_high = row
                    if relative_high is not None:
                        book.highs[folder] = max(book.highs.get(folder, 0), book.question + relative_high)
                    for o, p, n in highs:
                        place = (book.option if o is None else o, p)
                        book.highs[place] = max(book.highs.get(place, 0), n)
                    book.carry = (book.carry if keeps else 0) + carry
                    book.question = book.question + question if relative else question
                    book.option = book.option if option is None else option
                    book.part = part

        return _batches(records(), STATE)

    return run
