"""cadenza.streaming"""
