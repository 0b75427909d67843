"""Incremental (micro-batch) form of the block-statistics pass."""

from .statistics import (accumulate_block_statistics, problem_from_stream,
                         read_block_statistics, stream_sample_major)

__all__ = ["accumulate_block_statistics", "problem_from_stream", "read_block_statistics",
           "stream_sample_major"]
