"""strataflow.functions"""
