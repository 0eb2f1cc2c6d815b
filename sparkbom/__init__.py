"""Crypto-asset analytics and corpus preparation, expressed as Spark jobs."""
