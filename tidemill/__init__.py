"""Spark-native analytics: campaign funnels, text digests, question answering."""
