"""Training configuration as column arithmetic (MA6 to MA10, AG21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Recommended batch, largest batch and gradient accumulation by device.
BATCHES = (("NVIDIA RTX A6000", 8, 16, 2), ("NVIDIA A100", 6, 12, 2), ("NVIDIA RTX 6000 Ada", 8, 16, 2), ("NVIDIA RTX 4090", 2, 4, 4), ("NVIDIA RTX 3090", 1, 2, 8), ("NVIDIA RTX A5000", 4, 8, 2), ("NVIDIA L40", 6, 12, 2))
UNKNOWN = (1, 2, 4)
GIB = float(1 << 30)


def batch_of(name: Column) -> Column:
    """struct(batch_size, max_batch, grad_accum) of the first model that the device's name holds."""
    made = lambda b, m, g: F.struct(F.lit(b).alias("batch_size"), F.lit(m).alias("max_batch"), F.lit(g).alias("grad_accum"))
    out = made(*UNKNOWN)
    for model, *numbers in reversed(BATCHES):
        out = F.when(F.coalesce(F.lower(name).contains(model.lower()), F.lit(False)), made(*numbers)).otherwise(out)
    return out


def recommend(devices: DataFrame, host: str = "host") -> DataFrame:
    """A configuration for each host of a table (host, device, name, memory_gb); a host whose device is null has none."""
    first = F.min_by("name", "device")
    g = devices.groupBy(host).agg(F.count("device").alias("num_gpus"), F.coalesce(F.sum("memory_gb"), F.lit(0.0)).alias("total_memory_gb"), batch_of(first).alias("b"))
    none, several = F.col("num_gpus") == 0, F.col("num_gpus") >= 2
    batch = F.when(none, 1).when(several, F.least(F.col("b.batch_size") * 2, F.col("b.max_batch"))).otherwise(F.col("b.batch_size"))
    accum = F.when(none, 8).when(several, F.greatest(F.lit(1), F.floor(F.col("b.grad_accum") / 2).cast("int"))).otherwise(F.col("b.grad_accum"))
    place = F.when(none, "cpu").when(several, "auto").otherwise("cuda:0")
    return g.select(host, "num_gpus", "total_memory_gb", batch.alias("batch_size"), accum.alias("grad_accum"), F.when(~none, F.col("b.max_batch")).alias("max_batch_size"), F.lit(2e-4).alias("learning_rate"), place.alias("device_map"))


def memory(billions: Column, sequence: Column, batch: Column, bits: Column) -> Column:
    """struct of gigabytes for weights, optimizer, activations and all of them, before rounding."""
    weights = billions * 1e9 * F.when(bits == 4, 0.5).otherwise(2.0) / GIB
    acts = batch * sequence * 4096.0 * 4 / GIB
    return F.struct(weights.alias("weights_gb"), (weights * 0.5).alias("optimizer_gb"), acts.alias("activations_gb"), (weights * 1.5 + acts).alias("total_gb"))


def batch_for_memory(total_gb: Column) -> Column:
    return F.when(total_gb >= 90, 8).when(total_gb >= 40, 4).when(total_gb >= 24, 2).otherwise(1)


#: The models that short names stand for.
MODELS = {
    "qwen2.5-7b": "unsloth/Qwen2.5-7B-Instruct-bnb-4bit",
    "qwen2.5-14b": "unsloth/Qwen2.5-14B-Instruct-bnb-4bit",
    "qwen2.5-32b": "unsloth/Qwen2.5-32B-Instruct-bnb-4bit",
    "llama3-8b": "unsloth/llama-3-8b-Instruct-bnb-4bit",
    "llama3.1-8b": "unsloth/Meta-Llama-3.1-8B-Instruct-bnb-4bit",
    "llama3.2-3b": "unsloth/Llama-3.2-3B-Instruct-bnb-4bit",
    "deepseek-7b": "unsloth/DeepSeek-R1-Distill-Qwen-7B-bnb-4bit",
    "deepseek-14b": "unsloth/DeepSeek-R1-Distill-Qwen-14B-bnb-4bit",
    "mistral-7b": "unsloth/mistral-7b-instruct-v0.3-bnb-4bit",
    "gemma2-9b": "unsloth/gemma-2-9b-it-bnb-4bit",
}


def parameter_shares(parameters: DataFrame, by: str | None = None) -> DataFrame:
    """Trainable and all parameters of a table (numel, trainable), and the former's share in percent."""
    rows = parameters.groupBy(by) if by else parameters.groupBy()
    out = rows.agg(F.coalesce(F.sum(F.when(F.col("trainable"), F.col("numel"))), F.lit(0)).alias("trainable_params"), F.sum("numel").alias("total_params"))
    return out.withColumn("trainable_percent", F.try_divide(F.col("trainable_params") * 100.0, F.col("total_params").cast("double")))


def resolve(alias: Column, names: dict[str, str] = MODELS) -> Column:
    """The name that an alias stands for; others stand for themselves."""
    out = alias
    for k, v in names.items():
        out = F.when(alias == k, v).otherwise(out)
    return out
