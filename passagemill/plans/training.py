"""The command that trains an embedding model on the splits: built and checked here, run elsewhere."""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass


@dataclass
class Training:
    train_file: str = "data/splits/train.jsonl"
    output_dir: str = "models/finetuned"
    model: str = "base-model"
    module: str = "FlagEmbedding.finetune.embedder.encoder_only.m3"
    num_gpus: int = 1
    cuda_visible_devices: str | None = None
    epochs: int = 1
    learning_rate: float = 1e-5
    batch_size: int = 1
    train_group_size: int = 8
    query_max_length: int = 512
    passage_max_length: int = 2048
    precision: str = "fp16"
    seed: int = 42
    warmup_ratio: float = 0.1
    save_steps: int = 1000
    logging_steps: int = 10
    save_total_limit: int = 2
    cache_dir: str | None = "cache/models"
    data_cache_dir: str | None = "cache/data"
    overwrite_output_dir: bool = False


#: Options of the training module that are always the same.
FIXED = {
    "pad_to_multiple_of": 8, "knowledge_distillation": False, "same_dataset_within_batch": True, "small_threshold": 0, "drop_threshold": 0,
    "dataloader_drop_last": True, "gradient_checkpointing_kwargs": '{"use_reentrant": false}', "ddp_find_unused_parameters": True, "disable_tqdm": False,
    "temperature": 0.02, "sentence_pooling_method": "cls", "normalize_embeddings": True, "unified_finetuning": False, "use_self_distill": False, "fix_encoder": False,
}


def check(t: Training) -> None:
    if not os.path.isfile(t.train_file):
        raise ValueError(f"no such file: {t.train_file}")
    if t.num_gpus < 1 or t.batch_size < 1 or t.train_group_size < 2:
        raise ValueError("num_gpus and batch_size must be at least 1, train_group_size at least 2")
    if t.precision not in ("fp16", "bf16", "fp32"):
        raise ValueError("precision is fp16, bf16 or fp32")
    if t.cuda_visible_devices and len(t.cuda_visible_devices.split(",")) != t.num_gpus:
        raise ValueError("cuda_visible_devices must name num_gpus devices")
    if os.path.isdir(t.output_dir) and os.listdir(t.output_dir) and not t.overwrite_output_dir:
        raise ValueError(f"{t.output_dir} is not empty")


def command(t: Training) -> list[str]:
    options = {
        "model_name_or_path": t.model, "train_data": t.train_file, "output_dir": t.output_dir, "num_train_epochs": t.epochs, "learning_rate": t.learning_rate,
        "per_device_train_batch_size": t.batch_size, "train_group_size": t.train_group_size, "query_max_len": t.query_max_length, "passage_max_len": t.passage_max_length,
        "seed": t.seed, "warmup_ratio": t.warmup_ratio, "save_steps": t.save_steps, "logging_steps": t.logging_steps, "save_total_limit": t.save_total_limit,
        **FIXED,
        "cache_dir": t.cache_dir, "cache_path": t.data_cache_dir,
    }
    out = [sys.executable, "-m", "torch.distributed.run", "--nproc_per_node", str(t.num_gpus), "-m", t.module]
    for k, v in options.items():
        if v is not None:
            out += [f"--{k}", str(v)]
    out += ["--gradient_checkpointing"]
    flags = {"fp16": t.precision == "fp16", "bf16": t.precision == "bf16", "negatives_cross_device": t.num_gpus > 1, "overwrite_output_dir": t.overwrite_output_dir}
    return out + [f"--{k}" for k, on in flags.items() if on]


def environment(t: Training, base: dict[str, str]) -> dict[str, str]:
    return {"WANDB_MODE": "disabled", **base, **({"CUDA_VISIBLE_DEVICES": t.cuda_visible_devices} if t.cuda_visible_devices else {})}
