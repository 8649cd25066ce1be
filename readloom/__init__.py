"""Quality control of sequencing reads, as DataFrame transformations."""

__version__ = "0.1.0"
