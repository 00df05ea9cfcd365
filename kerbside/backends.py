"""Backends with a model. Their libraries are imported when a model is loaded, on the executors, once a worker process.

Each takes what it needs by name, so that an executor can build it from options alone; ``available`` says whether it can run
where it is asked. Answers are greedy, so they are the same each time.
"""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Sequence

import numpy as np

DESCRIBE_MODEL = "Qwen/Qwen3-VL-2B-Instruct"
EMBED_MODEL = "Qwen/Qwen3-VL-Embedding-2B"
MAX_TOKENS = 2048
SEED = 42


def last_token_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The state of each row's last token that is no padding, from states (rows, tokens, width) and mask (rows, tokens).

    If every row's last place is taken, padding is on the left and that place is meant. A row of padding alone gives its first state.
    """
    states, mask = np.asarray(states), np.asarray(mask).astype(bool)
    width = mask.shape[1]
    last = np.where(mask.any(axis=1), width - 1 - mask[:, ::-1].argmax(axis=1), 0)
    return states[np.arange(len(states)), last]


def words(text: str) -> dict:
    return dict(type="text", text=text)


def picture(image) -> dict:
    return dict(type="image", image=image)


def chat(system: str, content: list[dict]) -> list[dict]:
    return [dict(role=role, content=parts) for role, parts in (("system", [words(system)]), ("user", content))]


def _there(*modules: str) -> bool:
    return all(importlib.util.find_spec(m) is not None for m in modules)


def _gpus() -> int:
    if not _there("torch"):
        return 0
    import torch

    return torch.cuda.device_count() if torch.cuda.is_available() else 0


def _numbers(tensor) -> np.ndarray:
    return np.asarray(tensor.float().cpu().numpy() if hasattr(tensor, "cpu") else tensor)


class _Vllm:
    """What both vLLM backends share: one engine over the worker's GPUs, and chat messages as its inputs."""

    settings: dict = {}

    def __init__(self, model: str, gpu_memory: float = 0.8, gpus: int | None = None):
        self.model, self.gpu_memory, self.gpus = model, gpu_memory, gpus
        self._engine = self._processor = None

    @staticmethod
    def available() -> bool:
        return _there("vllm") and _gpus() > 0

    def engine(self):
        if self._engine is None:
            os.environ.setdefault("VLLM_WORKER_MULTIPROC_METHOD", "spawn")
            from transformers import AutoProcessor
            from vllm import LLM

            self._processor = AutoProcessor.from_pretrained(self.model, trust_remote_code=True)
            self._engine = LLM(model=self.model, trust_remote_code=True, gpu_memory_utilization=self.gpu_memory, tensor_parallel_size=self.gpus or max(1, _gpus()), seed=SEED, **self.settings)
        return self._engine

    def inputs(self, talks: Sequence[list[dict]]) -> list[dict]:
        from qwen_vl_utils import process_vision_info

        made = []
        for talk in talks:
            images, videos, extra = process_vision_info(talk, return_video_kwargs=True)
            media = {k: v for k, v in (("image", images), ("video", videos)) if v is not None}
            made.append({"prompt": self._processor.apply_chat_template(talk, tokenize=False, add_generation_prompt=True), "multi_modal_data": media, "mm_processor_kwargs": extra})
        return made


class VllmDescriber(_Vllm):
    """Describes a batch of images in one call."""

    def __init__(self, model: str = DESCRIBE_MODEL, gpu_memory: float = 0.8, gpus: int | None = None, max_tokens: int = MAX_TOKENS, temperature: float = 0.0):
        super().__init__(model, gpu_memory, gpus)
        self.max_tokens, self.temperature = max_tokens, temperature

    def generate(self, images: Sequence[str], system: str, user: str) -> list[str]:
        engine = self.engine()
        from vllm import SamplingParams

        talks = [chat(system, [picture(i), words(user)]) for i in images]
        found = engine.generate(self.inputs(talks), sampling_params=SamplingParams(temperature=self.temperature, max_tokens=self.max_tokens))
        return [f.outputs[0].text for f in found]


class VllmEmbedder(_Vllm):
    """Embeds a batch of messages in one call, by the engine's own pooling."""

    settings = {"runner": "pooling", "dtype": "bfloat16"}

    def __init__(self, model: str = EMBED_MODEL, gpu_memory: float = 0.8, gpus: int | None = None):
        super().__init__(model, gpu_memory, gpus)

    def embed(self, items: Sequence[list[dict]], instruction: str) -> np.ndarray:
        engine = self.engine()
        return np.array([f.outputs.embedding for f in engine.embed(self.inputs([chat(instruction, item) for item in items]))], np.float32)


class _Transformers:
    """What both Transformers backends share; they take one message at a time, on a GPU or not."""

    kind = ""

    def __init__(self, model: str, device: str = "auto", dtype: str = "auto"):
        self.model, self.device, self.dtype = model, device, dtype
        self._network = self._processor = None

    @staticmethod
    def available() -> bool:
        return _there("transformers", "torch")

    def load(self) -> None:
        if self._network is None:
            import torch
            import transformers

            dtype = getattr(torch, self.dtype) if self.dtype != "auto" else torch.bfloat16 if _gpus() else torch.float32
            self._processor = transformers.AutoProcessor.from_pretrained(self.model, trust_remote_code=True)
            self._network = getattr(transformers, self.kind).from_pretrained(self.model, device_map=self.device, trust_remote_code=True, torch_dtype=dtype)

    def tensors(self, talk: list[dict], **more):
        from qwen_vl_utils import process_vision_info

        images, videos = process_vision_info(talk)
        media = {k: v for k, v in (("images", images), ("videos", videos)) if v}
        text = self._processor.apply_chat_template(talk, tokenize=False, add_generation_prompt=True)
        return self._processor(text=[text], return_tensors="pt", padding=True, **media, **more).to(self._network.device)


class TransformersDescriber(_Transformers):
    kind = "AutoModelForVision2Seq"

    def __init__(self, model: str = DESCRIBE_MODEL, device: str = "auto", dtype: str = "auto", max_tokens: int = MAX_TOKENS, temperature: float = 0.0):
        super().__init__(model, device, dtype)
        self.max_tokens, self.temperature = max_tokens, temperature

    def generate(self, images: Sequence[str], system: str, user: str) -> list[str]:
        self.load()
        import torch

        warm = {"do_sample": True, "temperature": self.temperature} if self.temperature > 0 else {"do_sample": False}
        told = []
        for image in images:
            given = self.tensors(chat(system, [picture(image), words(user)]))
            with torch.no_grad():
                ids = self._network.generate(**given, max_new_tokens=self.max_tokens, **warm)
            told += self._processor.batch_decode(ids[:, given["input_ids"].shape[-1] :], skip_special_tokens=True)
        return told


class TransformersEmbedder(_Transformers):
    kind = "AutoModel"

    def __init__(self, model: str = EMBED_MODEL, device: str = "auto", dtype: str = "auto", max_length: int = 8192):
        super().__init__(model, device, dtype)
        self.max_length = max_length

    def embed(self, items: Sequence[list[dict]], instruction: str) -> np.ndarray:
        self.load()
        import torch

        found = []
        for item in items:
            given = self.tensors(chat(instruction, item), max_length=self.max_length, truncation=True)
            with torch.no_grad():
                states = self._network(**given).last_hidden_state
            found.append(last_token_pool(_numbers(states), _numbers(given["attention_mask"])))
        return np.concatenate(found).astype(np.float32)
