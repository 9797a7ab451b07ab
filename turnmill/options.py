"""The option list of packing, planning and run analysis."""

from __future__ import annotations

from dataclasses import dataclass

THINKING = ("off", "xhigh", "medium", "low")
OVERLENGTH = ("skip", "split", "truncate")


@dataclass(frozen=True)
class PackOptions:
    """How conversations become samples. A truncating policy needs ``allow_truncation``."""

    max_len: int = 16384
    thinking: str = "off"
    overlength: str = "split"
    allow_truncation: bool = False
    max_per_prompt: int = 0
    holdout_head: int = 64
    shuffle_seed: int = 1234
    limit: int = 0
    shards: int = 64
    verify: int = 48
    allow_loose_special: bool = False
    stats_only: bool = False
    resume: bool = False
    block_tokens: int = 64 << 20  # tokens of a file, so of a writing task
    tokenizer: str = ""  # a tokenizer file (.json, .model) that all workers can read; empty: the native one

    def __post_init__(self) -> None:
        if self.thinking not in THINKING:
            raise ValueError("bad_thinking_mode")
        if self.overlength not in OVERLENGTH:
            raise ValueError(f"overlength must be one of {OVERLENGTH}")
        if self.overlength == "truncate" and not self.allow_truncation:
            raise ValueError("truncation drops scored tokens; set allow_truncation to consent")


@dataclass(frozen=True)
class PlanOptions:
    """How samples are dealt to workers, and when a run stops."""

    eval_frac: float = 0.15
    eval_max: int = 64
    min_samples: int = 8
    length_bucketed: bool = True
    bucket_seed: int = 1234
    accum: int = 1
    max_len: int = 65536
    steps: int = 200
    lr: float = 1e-4
    early_stop_patience: int = 3
    early_stop_min_delta: float = 0.0018
    overfit_tol: float = 0.02
    eval_every: int = 25


#: Result codes of a packing run.
PACK_OK, STATS_OK, EMPTY_OUTPUT, VERIFY_FAILED = 0, 0, 4, 5
