"""Readers that give DataFrames: pipe-delimited text and Parquet."""

from .delimited import read_pipe, write_pipe
from .scratch import scratch, shared_dir
from .tables import Tables, read_table

__all__ = ["Tables", "read_pipe", "read_table", "scratch", "shared_dir", "write_pipe"]
