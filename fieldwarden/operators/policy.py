"""What a run may store, show and claim: retention and value policy, what the source can prove, the verdict and a file's suffix."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

from fieldwarden.streaming.changes import Run, outcome

#: Value modes, the least telling first.
MODES = ("locations", "identifier-redacted", "raw")


@dataclass(frozen=True)
class Policy:
    """Days and sizes a run is held to; the defaults are those of a project that sets none."""

    value_mode: str = MODES[0]
    value_days: int = 30
    run_days: int = 90
    findings: int = 1_000_000
    size: int = 512 << 20
    hash_records: bool = False

    def spent(self, rows: int, size: int) -> bool:
        """Whether the room for findings is used up: either bound alone is enough."""
        return rows >= self.findings or size >= self.size


LIMITS = tuple(f.name for f in fields(Policy) if f.type in ("int", int))


def positive(value: object, otherwise: int) -> int:
    """A positive whole number, also as text; anything else is malformed and gives the other."""
    if isinstance(value, str) and re.fullmatch(r"\s*[0-9]+\s*", value):
        value = int(value)
    return value if isinstance(value, int) and not isinstance(value, bool) and value > 0 else otherwise


def rank(mode: object) -> int:
    """How much a mode shows; an unknown one counts as the least."""
    return MODES.index(mode) if mode in MODES else 0


def resolve(system: Mapping[str, object], project: Mapping[str, object]) -> Policy:
    """A project may ask for less than the system's bounds, never for more. Malformed settings give the default."""
    bounds = {}
    for name in LIMITS:
        most = positive(system.get(name), getattr(Policy, name))
        bounds[name] = min(most, positive(project.get(name), most))
    return Policy(MODES[rank(project.get("value_mode"))], hash_records=bool(project.get("hash_records")), **bounds)


def least(mode: str, other: str) -> str:
    """The mode that shows less."""
    return MODES[min(rank(mode), rank(other))]


def tightened(old: Policy, new: Policy) -> bool:
    """Whether anything that was stored under the old policy has to be cut down at once."""
    less = any(getattr(new, name) < getattr(old, name) for name in LIMITS)
    return less or rank(new.value_mode) < rank(old.value_mode) or new.hash_records and not old.hash_records


#: What a source can do, and what a run lacks without it. Without the first there is no run.
CAPABILITIES = {
    "records": "the record list can't be read in bounded memory, so no scan may run",
    "fence": "records can't be proved unchanged, so a run claims at most its opening list",
    "repeats": "a repeating form without instances can't be told from an absent one",
    "event_names": "events are named by id",
    "group_names": "groups are named by id",
    "schema": "tables have to be made by an administrator",
}


@dataclass(frozen=True)
class Claim:
    may_scan: bool
    most: str  # the strongest coverage a run may state
    incremental: bool
    limits: tuple[str, ...]


def claim(can: Mapping[str, bool]) -> Claim:
    """What runs over a source may claim. A capability that is missing, or was not probed, only ever lowers it."""
    if not can.get("records"):
        return Claim(False, "partial", False, (CAPABILITIES["records"],))
    fenced = bool(can.get("fence"))
    return Claim(True, "complete-through-fence" if fenced else "manifest-complete", fenced, tuple(said for name, said in CAPABILITIES.items() if not can.get(name)))


def verdict(run: Run) -> dict[str, object]:
    """What a report says of a run: clean needs a complete run, a proved fence, no findings and no rule left out."""
    word = outcome(run)
    complete = word in ("complete", "clean")
    coverage = "complete-through-fence" if complete or word == "truncated" else word if word == "manifest-complete" else "partial"
    return {"complete": complete, "coverage": coverage, "fenced": coverage == "complete-through-fence", "clean": word == "clean"}


def suffix(run: Run) -> str:
    """What an export's file name says after its title: the weakest claim, and whether findings were left out."""
    word = outcome(run)
    ends = {"failed": "_FAILED", "cancelled": "_CANCELLED", "expired": "_EXPIRED", "manifest-complete": "_MANIFEST_ONLY", "clean": "", "complete": "", "truncated": ""}
    return ends.get(word, "_INCOMPLETE") + ("_TRUNCATED" if run.truncated else "")


def unready(states: Mapping[str, int], unique_done: bool, rollup_done: bool, ended: bool = False) -> str | None:
    """Why a run can't be ended yet, None if it can. Records that are gone hold nothing up, and a cancelled or failed run waits for nothing."""
    if ended:
        return None
    if states.get("pending", 0) > 0:
        return "records are still waiting to be examined"
    if not unique_done:
        return "duplicate values have not been decided"
    return None if rollup_done else "the summary has not been built"
