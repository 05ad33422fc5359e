"""strataflow.plans"""
