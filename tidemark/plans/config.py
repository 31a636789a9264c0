"""The rule set of the activity state machine as one frozen value."""

from __future__ import annotations

from dataclasses import dataclass

#: The deployed order of signals that share a millisecond.
TIE_ORDER = ("START", "PLAY", "FG", "RESUME", "PAUSE", "BG", "ERR", "END", "HB")


@dataclass(frozen=True)
class Rules:
    """``timeout_s``: silence after which a session is no longer watching.  ``fg_default`` and ``playing_default``: gate
    states before the first marker.  ``error_policy``: 'liveness' (an error only proves life), 'inactive' (it stops
    playing) or 'terminal' (it ends the session).  ``ignore_downloads`` takes download events out altogether.
    ``use_fg``, ``use_playing``, ``use_liveness`` switch single gates off, for ablation."""

    timeout_s: int = 90
    fg_default: int = 1
    playing_default: int = 0
    tie_order: tuple[str, ...] = TIE_ORDER
    error_policy: str = "liveness"
    ignore_downloads: bool = False
    use_fg: bool = True
    use_playing: bool = True
    use_liveness: bool = True

    def __post_init__(self):
        if self.error_policy not in ("liveness", "inactive", "terminal"):
            raise ValueError(f"unknown error policy {self.error_policy!r}")
        if sorted(self.tie_order) != sorted(TIE_ORDER):
            raise ValueError("tie_order must hold every signal once")

    @property
    def timeout_ms(self) -> int:
        return self.timeout_s * 1000


DEFAULT = Rules()
