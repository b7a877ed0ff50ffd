"""fluxalign: controlled multimodal experiments as Spark jobs."""
