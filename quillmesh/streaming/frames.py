"""Frames of the streaming protocol as JSON lines, and the stream that keeps proposals while they pass."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

#: Proposals are kept after so many new ones.
EVERY = 5
#: Values of log lines are cut to this length.
VALUE = 40
#: The kinds of frames and what each holds.
FIELDS = {
    "phase": ("phase",), "context": ("notes", "conflicts", "session_id"), "delta": ("content",), "done": ("citations", "full_response"),
    "suggestions": ("questions",), "verification": ("citations",), "agent_step": ("step_number", "action", "params", "result_summary", "notes_found", "reasoning"),
    "grounding": ("claims", "overall_score"), "error": ("message",),
}
#: What a frame may leave out.
OPTIONAL = {"phase": ("detail",), "done": ("citation_warnings",)}


def frame(kind: str, seq: int | None = None, **values: object) -> bytes:
    """One line of the protocol. A missing field or an unknown one is an error."""
    needed, more = FIELDS[kind], OPTIONAL.get(kind, ())
    if set(needed) - values.keys() or values.keys() - set(needed) - set(more):
        raise ValueError(f"a {kind} frame has {', '.join(needed)}")
    body = {"type": kind, **{k: v for k, v in values.items() if k in needed or v not in (None, "")}}
    return (json.dumps(body if seq is None else {**body, "seq": seq}, ensure_ascii=False) + "\n").encode()


def numbered(frames: Iterable[tuple[str, dict]]) -> Iterator[bytes]:
    """Frames with their numbers from 1."""
    for seq, (kind, values) in enumerate(frames, 1):
        yield frame(kind, seq, **values)


def gaps(lines: Iterable[bytes]) -> list[tuple[int, int]]:
    """(expected, got) wherever the numbers of received frames don't go on by one."""
    out, expected = [], None
    for line in lines:
        seq = json.loads(line).get("seq")
        if seq is not None:
            if expected is not None and seq != expected:
                out.append((expected, seq))
            expected = seq + 1
    return out


def persisting(lines: Iterable[bytes], save: Callable[[list[dict]], None], every: int = EVERY) -> Iterator[bytes]:
    """Passes lines on as they are. Proposals are saved after every few new ones, and the set of a closing frame (proposals or
    label_updates) takes their place at once. Lines that are no frames pass too. Closing this closes the source."""
    partial: list[dict] = []
    fresh = 0
    try:
        for line in lines:
            try:
                got = json.loads(line)
            except ValueError:
                got = None
            if isinstance(got, dict):
                if got.get("type") == "proposal" and got.get("proposal"):
                    partial.append(got["proposal"])
                    fresh += 1
                    if fresh >= every:
                        save(list(partial))
                        fresh = 0
                elif got.get("type") in ("proposals", "label_updates") and got.get("proposals"):
                    partial, fresh = list(got["proposals"]), 0
                    save(list(partial))
            yield line
    finally:
        close = getattr(lines, "close", None)
        if close:
            close()


def described(error: BaseException) -> str:
    """An error by its type and status alone, since its message may hold a note's text."""
    status = getattr(error, "status_code", getattr(getattr(error, "response", None), "status_code", None))
    known = not isinstance(status, bool) and re.fullmatch(r"\d+", str(status))
    return f"{type(error).__name__}(status={int(status)})" if known else type(error).__name__


def log_line(**values: object) -> str:
    """Counts, ids and times as key=value; texts are cut."""

    def shown(v: object) -> str:
        if isinstance(v, str):
            return repr(v[:VALUE]) + (f"+{len(v) - VALUE}" if len(v) > VALUE else "")
        return f"{v:.3f}" if isinstance(v, float) else str(v)

    return " ".join(f"{k}={shown(v)}" for k, v in values.items())
