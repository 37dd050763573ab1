"""Settings of the dataset builders, as frozen dataclasses that check themselves."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lengths:
    """Least and most characters of what goes into an example."""

    least_user: int = 20
    least_assistant: int = 20
    question: int = 2000
    explanation: int = 2800
    reference_answer: int = 4000
    notes_input: int = 12000
    notes_output: int = 3500
    task_input: int = 8000
    task_output: int = 3500
    general_input: int = 6000
    general_output: int = 2200

    def __post_init__(self) -> None:
        if min(vars(self).values()) < 0:
            raise ValueError("lengths can't be negative")


@dataclass(frozen=True)
class DialogueRules:
    """How raw dialogues become examples."""

    most_messages: int = 12
    least_messages: int = 2
    least_user: int = 20
    least_assistant: int = 20
    drop_provider_openings: bool = False

    def __post_init__(self) -> None:
        if self.most_messages < 1 or self.least_messages < 0:
            raise ValueError("a dialogue holds at least one message")


@dataclass(frozen=True)
class MixtureTarget:
    """How many examples of a source a stage takes, and the seed of the draw."""

    stage: str
    source: str
    target: int
    seed: int


@dataclass(frozen=True)
class SplitSize:
    """Validation and test rows of a source without official splits; test is served first."""

    source: str
    val: int
    test: int
    seed: int


@dataclass(frozen=True)
class MixturePlan:
    """Sources by falling priority, those that tolerate a shared first question, split sizes and targets."""

    priority: tuple[str, ...]
    lenient: tuple[str, ...] = ()
    splits: tuple[SplitSize, ...] = ()
    targets: tuple[MixtureTarget, ...] = ()
    shuffle_seed: int = 42
    prompts: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(set(self.priority)) != len(self.priority):
            raise ValueError("a source has one priority")
        unknown = {t.source for t in (*self.splits, *self.targets)}.union(self.lenient).difference(self.priority)
        if unknown:
            raise ValueError(f"sources without priority: {sorted(unknown)}")


#: The recipes with their published sizes. Sources are named by kind.
DIALOGUE_PLAN = MixturePlan(
    priority=("followup", "exam_dialogue", "consult", "notes"),
    lenient=("followup", "exam_dialogue"),
    splits=(SplitSize("consult", 1500, 1500, 42), SplitSize("exam_dialogue", 500, 500, 43), SplitSize("notes", 200, 200, 44)),
    targets=(
        MixtureTarget("stage1", "consult", 90000, 52), MixtureTarget("stage1", "followup", 18000, 53), MixtureTarget("stage1", "notes", 4000, 54), MixtureTarget("stage1", "exam_dialogue", 12000, 55),
        MixtureTarget("stage2", "consult", 6000, 62), MixtureTarget("stage2", "followup", 12000, 63), MixtureTarget("stage2", "notes", 600, 64), MixtureTarget("stage2", "exam_dialogue", 10000, 65),
    ),
)
KNOWLEDGE_PLAN = MixturePlan(
    priority=("choice", "reference", "notes", "task", "general"),
    splits=(SplitSize("reference", 1200, 1200, 52), SplitSize("notes", 200, 200, 53), SplitSize("task", 500, 500, 54), SplitSize("general", 200, 200, 55)),
    targets=(
        MixtureTarget("stage1", "choice", 38000, 63), MixtureTarget("stage1", "reference", 18000, 64), MixtureTarget("stage1", "task", 3500, 65), MixtureTarget("stage1", "notes", 2208, 66),
        MixtureTarget("stage1", "general", 3000, 67),
    ),
)


@dataclass(frozen=True)
class TrainingRun:
    """The settings of a training run that its data depends on, as its run configuration holds them."""

    max_seq_length: int = 2048
    epochs: float = 1.0
    batch: int = 4
    accumulation: int = 16
    learning_rate: float = 5e-5
    warmup_ratio: float = 0.03
    seed: int = 42
    shuffle_seed: int = 42
    bf16: bool = False
    fp16: bool = False
    gradient_checkpointing: bool = False
    no_gradient_checkpointing: bool = False
    target_modules: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for a, b in (("bf16", "fp16"), ("gradient_checkpointing", "no_gradient_checkpointing")):
            if getattr(self, a) and getattr(self, b):
                raise ValueError(f"{a} and {b} exclude each other")
        if min(self.max_seq_length, self.batch, self.accumulation) < 1:
            raise ValueError("lengths and batches hold at least one")

    @property
    def effective_batch(self) -> int:
        """Examples of an optimiser step on one device."""
        return self.batch * self.accumulation
