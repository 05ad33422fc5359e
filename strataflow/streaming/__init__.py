"""strataflow.streaming"""
