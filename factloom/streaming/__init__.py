"""factloom.streaming"""
