"""Sources: files (bounded or as a stream), DataFrames, rate and Kafka."""

from .files import FileFormat, InputFileConfiguration, SplitSize, read_files
from .generator import Watermark, generated, register
from .kafka import KafkaSink, KafkaSource

__all__ = ["FileFormat", "InputFileConfiguration", "KafkaSink", "KafkaSource", "SplitSize", "Watermark", "generated", "read_files", "register"]
