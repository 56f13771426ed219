"""Session settings that follow the amount of data."""

from __future__ import annotations

import math

_MB = 1024**2


def sized_settings(
    input_bytes: int, cores: int, broadcast_mb: int = 10
) -> dict[str, str]:
    """Settings for jobs that scan ``input_bytes`` on ``cores`` cores.

    The joins here carry a few narrow columns, about a fifth of what is stored, so shuffles get a
    partition per 512 MB of that, which a task sorts with little or no spilling. Scan splits
    grow with the root of the input, from 128 to 512 MB, because every scan task writes one block
    per shuffle partition.
    Adaptive execution merges partitions that turn out small and splits those a dominant key fills,
    here somewhat earlier than by default, because equal rows look small once compressed.
    It may broadcast a side it has measured at up to ``broadcast_mb``; estimates keep Spark's own
    limit.
    """
    split_mb = min(512, max(128, math.isqrt(input_bytes // (16 * _MB))))
    partitions = max(cores, math.ceil(input_bytes / 5 / (512 * _MB)))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": f"{split_mb}m",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": f"{broadcast_mb}m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{max(64, split_mb // 4)}m",
    }
