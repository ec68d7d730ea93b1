"""Parameters with typed defaults. Unknown names and bad values raise."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


def _parsed(text: object, default: object) -> object:
    if not isinstance(text, str):
        return text
    if isinstance(default, bool):
        low = text.lower()
        if low in ("1", "true", "t", "yes", "y"):
            return True
        if low in ("0", "false", "f", "no", "n", ""):
            return False
        raise ValueError(f"not a truth value: {text}")
    return type(default)(text)


@dataclass(frozen=True)
class ModelParams:
    """What every workload takes."""

    debug: bool = False
    print_num_words_per_topic: int = 50
    shuffle_data: bool = False
    test_num_iters: int = 5
    alpha: float = 0.1
    beta: float = 0.1
    init_seed: int = -1
    num_topics: int = 3
    ltr_num_particles: int = 20
    ltr_eval: bool = False
    skip_oov: bool = False

    @classmethod
    def of(cls, **given: object):
        known = {f.name: f.default for f in fields(cls)}
        if unknown := sorted(set(given) - set(known)):
            raise ValueError(f"unknown parameters: {', '.join(unknown)}")
        return cls(**{k: _parsed(v, known[k]) for k, v in given.items()})

    def dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class BatchParams(ModelParams):
    """For batch learning on unlabelled text; num_docs -1 takes all."""

    num_docs: int = -1
    num_iters: int = 100


@dataclass(frozen=True)
class GibbsParams(ModelParams):
    """For batch learning on labelled text; init_num_docs -1 takes all."""

    init_num_docs: int = -1
    init_num_iters: int = 100
    coherence_num_words: int = 10
    init_topic_list_filename: str = ""


@dataclass(frozen=True)
class FilterParams(ModelParams):
    """For the online filter; the reservoir and the rejuvenation sample count documents."""

    reservoir_size: int = 1000
    ess_threshold: float = 20.0
    resample_per_token: bool = False
    forget_stats: bool = False
    init_num_docs: int = 100
    init_num_iters: int = 100
    init_tune_num_runs: int = 1
    init_tune_eval_nmi: bool = False
    init_tune_num_cv_folds: int = 1
    init_tune_train_frac: float = 0.8
    num_particles: int = 100
    rejuv_sample_size: int = 30
    rejuv_mcmc_steps: int = 1
    coherence_num_words: int = 10
    init_topic_list_filename: str = ""

    def __post_init__(self) -> None:
        if self.init_tune_num_cv_folds < 1 and self.init_tune_num_runs > 1 and not self.init_tune_eval_nmi:
            raise ValueError("runs can be compared on their own training documents only by NMI")
