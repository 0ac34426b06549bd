"""Words that mean the same, as data; every function that uses them takes another table as well."""

from __future__ import annotations

# Concepts and the phrases that stand for them.
CONCEPTS = {
    "open": ["open-source", "open-weight", "open-weights", "opensource", "permissive", "apache", "mit license", "openly"],
    "moe": ["mixture-of-experts", "mixture of experts", "moe", "sparse experts", "experts", "mixtral"],
    "release": ["release", "released", "launch", "launched", "unveil", "unveiled", "announce", "announced", "introduce", "introduced", "debut", "debuted", "ship", "shipped", "publish", "published"],
    "chip": ["accelerator", "accelerators", "gpu", "gpus", "tpu", "chip", "chips", "silicon", "trainium", "maia", "blackwell", "instinct"],
    "partner": ["partner", "partnered", "partnership", "collaboration", "collaborate", "collaborated", "alliance", "teamed"],
    "model": ["model", "models", "llm", "llms", "language model", "foundation model"],
    "multimodal": ["multimodal", "vision", "image", "audio", "video", "omni", "natively multimodal"],
    "reasoning": ["reasoning", "chain-of-thought", "reinforcement", "think", "thinking"],
    "retrieval": ["retrieval", "rag", "retrieve", "grounding", "search"],
    "attention": ["attention", "transformer", "transformers", "self-attention"],
    "efficient": ["efficient", "efficiency", "cheaper", "lora", "low-rank", "parameter-efficient", "quantization"],
    "context": ["context window", "context length", "long context", "tokens of context"],
}

# What else a search word may be called.
EXPANSIONS = {
    "llm": ["large language model", "foundation model"],
    "llms": ["large language models"],
    "open-source": ["open-weight", "open weights", "openly available"],
    "open source": ["open-weight", "open weights"],
    "rag": ["retrieval-augmented generation"],
    "moe": ["mixture of experts"],
    "gpu": ["accelerator"],
    "accelerator": ["AI chip", "GPU", "TPU"],
    "accelerators": ["AI chips", "GPUs"],
    "released": ["introduced", "announced", "launched"],
    "release": ["introduce", "announce", "launch"],
    "partner": ["collaborate", "partnership"],
    "partnering": ["collaborating", "partnership"],
    "architecture": ["design", "attention", "experts"],
    "fine-tuning": ["LoRA", "parameter-efficient"],
}


def meant(text: str, concepts: dict[str, list[str]] = CONCEPTS, loose: bool = False) -> list[str]:
    """A concept for each of its phrases in the text, as words of their own; loose: long phrases also within words."""
    padded = f" {text.lower()} "
    return [name for name, phrases in concepts.items() for p in phrases if f" {p} " in padded or (loose and len(p) > 5 and p in padded)]
